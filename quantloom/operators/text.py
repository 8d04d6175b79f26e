"""Text operators on article and name columns; whole texts, JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: keyword lists of the two sentiment scores
POSITIVE = ["buy", "bullish", "growth", "profit", "beat", "exceed", "strong", "rise", "gain", "up", "positive", "optimistic"]
NEGATIVE = ["sell", "bearish", "loss", "miss", "weak", "fall", "drop", "down", "negative", "pessimistic", "concern", "risk"]
POSITIVE_SHORT = ["beat", "surge", "gain", "profit", "growth", "strong", "bullish", "upgrade"]
NEGATIVE_SHORT = ["miss", "fall", "loss", "weak", "bearish", "downgrade", "concern", "risk"]
# fixed values: company suffixes, and ordinary words that are no company name on their own
SUFFIXES = [
    "inc", "corp", "corporation", "company", "companies", "co", "ltd", "plc", "group", "holdings", "holding",
    "limited", "incorporated", "&", "and",
]
BARE_STOP = [
    "match", "booking", "ball", "dover", "progressive", "gap", "target", "southern", "discover", "extra", "on",
    "block", "first", "global", "american", "united", "general", "national", "international",
]
SHARE_CLASS = r"\s+(class [a-c]|common stock|common st|ordinary shares|\(the\)|\(de\)|\(new\))\s*$"


def hits(text: Column, words: list[str]) -> Column:
    """How many of ``words`` occur in the lowered text, as substrings."""
    lowered = F.lower(text)
    return reduce(lambda a, b: a + b, [F.contains(lowered, F.lit(w)).cast("int") for w in words])


def keyword_sentiment(text: Column) -> dict[str, Column]:
    pos, neg = hits(text, POSITIVE), hits(text, NEGATIVE)
    total = F.greatest(pos + neg, F.lit(1))
    return {
        "sentiment_score": (pos - neg) / total,
        "positive_prob": pos / total,
        "negative_prob": neg / total,
        "neutral_prob": 1 - (pos + neg) / total,
    }


def keyword_sentiment_sign(text: Column) -> Column:
    pos, neg = hits(text, POSITIVE_SHORT), hits(text, NEGATIVE_SHORT)
    return F.when(pos > neg, 0.5).when(neg > pos, -0.5).otherwise(0.0)


def _kept(name: Column) -> Column:
    return (F.length(name) >= 4) | name.rlike("[0-9]")


def normalize_names(df: DataFrame, symbol: str, name: str) -> DataFrame:
    """(symbol, variant) rows: spellings a news index may use for a company name."""
    base = F.regexp_replace(F.lower(F.trim(name)), SHARE_CLASS, "")
    base = F.regexp_replace(base, r"^the\s+", "")
    quote = F.lit("'")
    joined = F.replace(F.replace(F.col("_base"), F.lit("'s"), F.lit("s")), quote, F.lit(""))
    dropped = F.replace(F.regexp_replace(F.col("_base"), r"'s\b", ""), quote, F.lit(""))
    forms = F.when(F.contains("_base", quote), F.array(joined, dropped)).otherwise(F.array("_base"))

    def spellings(raw: Column) -> Column:
        f = F.regexp_replace(raw, "[.']", "")
        swap = lambda old, new: F.when(F.contains(f, F.lit(old)), F.replace(f, F.lit(old), F.lit(new)))
        made = F.array(f, swap("-", " "), swap("-", ""), swap("&", " and "), swap("&", " "), swap(" and ", " "))
        return F.array_compact(made)

    def clean(f: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(f, r"[^a-z0-9&\-\s]", " "), r"\s+", " "))

    tokens = "|".join(SUFFIXES)
    words = [*SUFFIXES, "the"]

    def cores(f: Column) -> Column:
        ended = F.regexp_replace(F.regexp_replace(f, f"( ({tokens}))+$", ""), f"^({tokens})$", "")
        inner = F.array_join(F.filter(F.split(f, " "), lambda w: ~w.isin(words)), " ")
        good = lambda c: (c != "") & (c != f) & ~c.isin(BARE_STOP) & _kept(c)
        return F.filter(F.array(ended, inner), good)

    spelled = df.select(F.col(symbol), base.alias("_base")).select(
        symbol, F.explode(F.flatten(F.transform(forms, spellings))).alias("_f")
    )
    cleaned = spelled.select(symbol, clean(F.col("_f")).alias("_f"))
    own = F.when(_kept(F.col("_f")), F.array("_f")).otherwise(F.array().cast("array<string>"))
    return cleaned.select(symbol, F.explode(F.concat(own, cores(F.col("_f")))).alias("variant")).distinct()


def relevant(title: Column, symbol: Column, names: Column) -> Column:
    """Title holds the symbol as a word, $symbol, or any of the names (all compared in lower case)."""
    t, s = F.lower(title), F.lower(symbol)
    word = F.contains(F.concat(F.lit(" "), t, F.lit(" ")), F.concat(F.lit(" "), s, F.lit(" ")))
    dollar = F.contains(t, F.concat(F.lit("$"), s))
    named = F.exists(names, lambda n: F.contains(t, F.lower(n)))
    kept = word | dollar | named
    # fixed values: two symbols that are also ordinary letters need their company's name
    return kept & ~((symbol == "V") & ~F.contains(t, F.lit("visa"))) & ~(
        (symbol == "MA") & ~F.contains(t, F.lit("mastercard"))
    )


def dedupe_articles(df: DataFrame, seq: str, url: str, title: str) -> DataFrame:
    """First article per url, then first per title. Only the sequence numbers are aggregated, not the rows."""
    by_url = df.groupBy(url).agg(F.min_by(F.struct(seq, title), seq).alias("_r")).select("_r.*")
    first = by_url.groupBy(title).agg(F.min(seq).alias(seq)).select(seq)
    return df.join(first, seq, "left_semi")


def daily_tone(articles: DataFrame, names: DataFrame) -> DataFrame:
    """Average tone and article count per (date, symbol); an article counts once per symbol.

    ``articles`` has date, id, orgs (``name,offset;name,offset``) and tone; ``names`` has symbol and org.
    """
    org = F.lower(F.trim(F.split(F.col("_entry"), ",")[0]))
    tokens = "|".join(t for t in SUFFIXES if t != "&")
    core = F.regexp_replace(F.regexp_replace(org, "^the ", ""), f"( ({tokens}|&))+$", "")
    entries = articles.where(F.col("tone").isNotNull()).select(
        "date", "id", "tone", F.explode(F.split("orgs", ";")).alias("_entry")
    )
    keys = entries.select("date", "id", "tone", F.explode(F.array_distinct(F.array(org, core))).alias("org"))
    found = keys.join(names.distinct(), "org").groupBy("date", "id", "symbol").agg(F.first("tone").alias("tone"))
    return found.groupBy("date", "symbol").agg(F.avg("tone").alias("tone"), F.count(F.lit(1)).alias("articles"))


def daily_sentiment(news: DataFrame) -> DataFrame:
    """Mean, standard deviation (0 for one article) and count of sentiment per (symbol, date)."""
    return news.groupBy("symbol", "date").agg(
        F.avg("score").alias("sentiment_mean"),
        F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sentiment_std"),
        F.count(F.lit(1)).alias("articles"),
    )
