"""Scalar functions over columns."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

EPS = 1e-9
#: Letters with marks and what they decompose into, from Unicode's tables: up to U+024F and the Latin additional block.
_DECOMPOSED = {c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in map(chr, [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)])}
_ACCENTED = "".join(c for c, plain in _DECOMPOSED.items() if len(plain) == 1 and plain != c)
_PLAIN = "".join(_DECOMPOSED[c] for c in _ACCENTED)


def normalize_symbol(s: Column) -> Column:
    """Trimmed, with UTF-8 read as Latin-1 repaired, in capitals, letters and digits only."""
    t = F.trim(s)
    garbled = t.rlike("[ÃÂÐÑ]") & ~t.rlike(r"[^\x00-\xFF]")
    fixed = F.when(garbled, F.regexp_replace(F.decode(F.encode(t, "ISO-8859-1"), "UTF-8"), "�", "")).otherwise(t)
    return F.regexp_replace(F.upper(fixed), "[^A-Z0-9]", "")


def is_legacy_symbol(s: Column) -> Column:
    return s.rlike(r"^[A-Z]{1,4}\d{1,2}$")


def remap_legacy(df: DataFrame, mapping: DataFrame, symbol: str = "ticker") -> DataFrame:
    """Legacy symbols replaced by their present ones (mapping: legacy, present); others stay."""
    m = mapping.select(F.col("legacy").alias("_l"), F.col("present").alias("_p"))
    out = df.join(m, F.col(symbol) == F.col("_l"), "left")
    return out.withColumn(symbol, F.when(is_legacy_symbol(F.col(symbol)), F.coalesce("_p", symbol)).otherwise(F.col(symbol))).drop("_l", "_p")


#: Share-class words that a company's name drops.
CLASS_WORDS = ("ON", "PN", "PNA", "PNB", "PNC", "UNIT", "UNT")


def normalize_company(s: Column) -> Column:
    """Capitals without accents, marks or share-class words, single-spaced; null is empty."""
    t = F.regexp_replace(F.translate(F.upper(F.coalesce(s, F.lit(""))), _ACCENTED, _PLAIN), r"\p{M}", "")
    words = F.split(F.trim(F.regexp_replace(t, "[^A-Z0-9]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*CLASS_WORDS, "")), " ")


def company_similarity(a: Column, b: Column) -> Column:
    """1 if equal, .95 or .9 if one begins with the other, else the ratio of matching blocks."""

    @pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)], dtype=float)

    some = (a != "") & (b != "")
    return F.when(~some, 0.0).when(a == b, 1.0).when(b.startswith(a), 0.95).when(a.startswith(b), 0.9).otherwise(ratio(a, b))


def resolve_ticker(raw: DataFrame, catalogue: DataFrame, threshold: float = 0.78, margin: float = 0.12) -> DataFrame:
    """Rows (ticker, company, kind) with the catalogue ticker each one stands for, as resolved.

    In turn: a ticker that the catalogue (ticker, company, kind) has; the only
    ticker of the same company and class; the only one of the same four-letter
    prefix and class; the company of the class most alike, if like enough and
    ahead of the next by the margin; else the ticker itself.

    Only keys that the first three steps leave open are compared, with the
    companies of their class that share two letters in a row with them, or,
    both having three letters at most, one. No pair as like as a threshold
    over .75 is lost: common blocks of single letters are at most 2n of 3n - 1
    letters, which is over .75 for n = 2 only, a name of two letters and one of three.
    """
    c = catalogue.select(F.col("ticker").alias("_t"), F.col("company").alias("_c"), F.col("kind").alias("_k"))
    one = F.when(F.count(F.lit(1)) == 1, F.min("_t"))
    exact = c.select(F.col("_t").alias("ticker"), F.col("_t").alias("_r1")).distinct()
    by_name = c.groupBy(F.col("_c").alias("company"), F.col("_k").alias("kind")).agg(one.alias("_r2"))
    by_code = c.groupBy(F.substring("_t", 1, 4).alias("_code"), F.col("_k").alias("kind")).agg(one.alias("_r3"))
    keys = raw.select("ticker", "company", "kind").distinct().withColumn("_code", F.substring("ticker", 1, 4))
    for settled, on in ((exact.filter("_r1 is not null"), ["ticker"]), (by_name.filter("_r2 is not null"), ["company", "kind"]), (by_code.filter("_r3 is not null"), ["_code", "kind"])):
        keys = keys.join(settled.select(*on), on, "left_anti")

    def blocks(name: str) -> Column:
        n = F.length(name)
        grams = lambda size: F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda k: F.substring(F.col(name), k, F.lit(size)))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.explode(F.array_distinct(F.when(n > 3, grams(2)).otherwise(F.concat(grams(2), grams(1)))))

    left = keys.drop("_code").filter("company <> ''").withColumn("_gram", blocks("company"))
    right = c.filter("_c <> ''").withColumn("_g", blocks("_c"))
    near = left.join(right, (F.col("kind") == F.col("_k")) & (F.col("_gram") == F.col("_g"))).select("ticker", "company", "kind", "_t", "_c", "_k").distinct()
    scored = near.withColumn("_s", company_similarity(F.col("company"), F.col("_c")))
    w = Window.partitionBy("ticker", "company", "kind").orderBy(F.col("_s").desc(), "_t")
    best = scored.withColumn("_n", F.row_number().over(w)).withColumn("_second", F.lead("_s").over(w)).filter("_n = 1")
    sure = (F.col("_s") >= threshold) & (F.col("_s") - F.coalesce("_second", F.lit(0.0)) >= margin)
    best = best.select("ticker", "company", "kind", F.when(sure, F.col("_t")).alias("_r4"))
    out = raw.join(exact, "ticker", "left").join(by_name, ["company", "kind"], "left").withColumn("_code", F.substring("ticker", 1, 4)).join(by_code, ["_code", "kind"], "left").join(best, ["ticker", "company", "kind"], "left")
    return out.withColumn("resolved", F.coalesce("_r1", "_r2", "_r3", "_r4", "ticker")).drop("_r1", "_r2", "_r3", "_r4", "_code")


def display_symbol(s: Column) -> Column:
    return F.regexp_replace(s, r"\.SA$", "")


def safe_int(s: Column) -> Column:
    return s.try_cast("double").try_cast("bigint")


def safe_float(s: Column) -> Column:
    d = s.try_cast("double")
    return F.when(~F.isnan(d), d)


def safe_bool(s: Column) -> Column:
    """True, false or null from words of two languages and digits."""
    t = F.lower(F.trim(s))
    return F.when(t.isin("1", "true", "t", "yes", "y", "sim", "s", "1.0"), True).when(t.isin("0", "false", "f", "no", "n", "não", "nao", "0.0"), False)


#: Characters that LaTeX reserves and how each is written.
LATEX = (("\\", r"\textbackslash{}"), ("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}"))


def latex_escape(s: Column) -> Column:
    """Each reserved character escaped once: what an escape writes isn't escaped again."""
    forms = F.create_map(*[F.lit(x) for pair in LATEX for x in pair])
    return F.array_join(F.transform(F.split(s, ""), lambda c: F.coalesce(forms[c], c)), "")


def company_number(s: Column) -> Column:
    """The first registry number of the form 00.000.000/0000-00, or null."""
    return F.nullif(F.regexp_extract(s, r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}", 0), F.lit(""))


def search_dimension(dim: DataFrame, term: str, field: str = "aliases") -> DataFrame:
    """Rows of a dimension of which the one field asked for, aliases, name or name_en, holds the term, or whose sigla equals it; case doesn't matter."""
    t = term.upper()
    if field not in ("aliases", "name", "name_en", "sigla"):
        raise ValueError("field: aliases, name, name_en or sigla")
    hit = F.exists("aliases", lambda a: F.upper(a).contains(t)) if field == "aliases" else F.upper("sigla") == t if field == "sigla" else F.upper(field).contains(t)
    return dim.filter(F.coalesce(hit, F.lit(False)))


def of_type(dim: DataFrame, kind: str) -> DataFrame:
    """The dimension's tickers of one type, such as principal or legacy."""
    return dim.filter(F.col("kind") == kind).select("ticker")


def aliases_of(dim: DataFrame, include_legacy: bool = True) -> DataFrame:
    """(ticker, aliases) as a simple table; legacy tickers have none unless included."""
    empty = F.expr("cast(array() as array<string>)")
    return dim.select("ticker", F.when(F.lit(include_legacy) | (F.coalesce("kind", F.lit("")) != "legacy"), F.coalesce("aliases", empty)).otherwise(empty).alias("aliases"))


def full_names(dim: DataFrame, lang: str = "pt") -> DataFrame:
    return dim.select("ticker", F.col("name_en" if lang == "en" else "name").alias("full_name"))


def timelines(dim: DataFrame) -> DataFrame:
    """(ticker, timeline): the ticker's own, or, where that is empty, that of the first ticker by name with the same sigla."""
    code = F.upper(F.trim("sigla"))
    some = dim.filter(F.size("timeline") > 0).groupBy(code.alias("_s")).agg(F.min_by("timeline", "ticker").alias("_other")).filter("_s <> ''")
    return dim.join(some, code == F.col("_s"), "left").select("ticker", F.when(F.size("timeline") > 0, F.col("timeline")).otherwise(F.coalesce("_other", "timeline")).alias("timeline"))


def edge_strength(distance: Column, weight: Column) -> Column:
    return F.when(distance > 0, 1 / (distance + EPS)).when(weight > 0, weight).otherwise(1.0)


def plot_strength(*candidates: Column) -> Column:
    return F.greatest(F.coalesce(*candidates, F.lit(EPS)), F.lit(EPS))


#: The families of metrics by name, in the order in which they are tried.
METRIC_FAMILIES = (
    (("ricci_fr_",), (), "Forman–Ricci geometric diagnostic"),
    (("dist_",), (), "raw PMFG distance context"),
    ((), ("modularidade", "num_communities", "community_residual_zscore", "ward_group_residual_zscore"), "mesoscopic structural diagnostic"),
    (("planar_",), (), "size-conditioned centrality residual"),
    ((), ("ks_stat",), "correlation-matrix validation diagnostic"),
)
OTHER_FAMILY = "correlation-matrix spectral diagnostic"


def metric_kind(name: Column) -> Column:
    """The family of a metric, by the beginning of its name or the whole of it."""
    out = F
    for prefixes, names, family in METRIC_FAMILIES:
        test = name.isin(*names) if names else F.lit(False)
        for p in prefixes:
            test = test | name.startswith(p)
        out = out.when(test, family)
    return out.otherwise(OTHER_FAMILY)


def direction(x: Column) -> Column:
    """up, down, or flat for 0, null and NaN, which have no sign."""
    return F.when((x > 0) & ~F.isnan(x), "up").when(x < 0, "down").otherwise("flat")


def year_month(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def sector_of(df: DataFrame, sectors: DataFrame, key: str = "ticker") -> DataFrame:
    """Adds sector, 'Outros' where the dimension (ticker, sector) has none."""
    s = sectors.select(F.col("ticker").alias("_t"), F.col("sector").alias("_s"))
    return df.join(s, F.col(key) == F.col("_t"), "left").withColumn("sector", F.coalesce("_s", F.lit("Outros"))).drop("_t", "_s")


def flatten_tree(tree: DataFrame) -> DataFrame:
    """A nested map sector -> subsector -> tickers as rows."""
    a = tree.select(F.explode("tree").alias("sector", "_subs")).select("sector", F.explode("_subs").alias("subsector", "_tickers"))
    return a.select("sector", "subsector", F.explode("_tickers").alias("ticker"))
