"""URL filter: rules first, then logistic regression on hashed character n-grams.

Host and path give character 1- to 5-grams, hashed to ``SLOTS`` slots. The model is trained
here, from the small labelled table below, by gradient descent with momentum in the dual: the weights are
a sum of the training rows, so each step multiplies a small Gram matrix with a vector.
DataFrame functions only, in training and in scoring; the model is ``SLOTS`` doubles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS, LENGTHS = 4096, (1, 2, 3, 4, 5)
STEPS, RATE, MOMENTUM, DECAY = 80, 12.0, 0.9, 0.0003
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Fixed values: (verdict, host, path prefix).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# The labelled table: common words of unwanted sites (gambling, drugs, adult, money, piracy, advertising, fakes) and of
# plain ones, in pairs that a rule forms alike on both sides. They were written down without looking at any table of URLs.
BAD_WORDS = (
    "poker", "slots", "roulette", "jackpot", "lottery", "wager", "viagra", "cialis", "steroids", "slimming", "diet", "xxx", "porn", "escort", "nude", "webcam",
    "payday", "loans", "forex", "crypto", "giveaway", "prize", "warez", "torrent", "crack", "keygen", "popup", "banner", "clicks", "traffic", "affiliate", "replica", "coupon", "fake",
)
GOOD_WORDS = (
    "news", "library", "science", "museum", "garden", "history", "docs", "wiki", "school", "university", "weather", "recipes", "travel", "music", "theatre", "health",
    "council", "journal", "archive", "forum", "church", "sports", "cooking", "gallery", "market", "railway", "river", "mountain", "language", "physics", "poetry", "village", "harbour", "climate",
)
DOMAINS = ("example.com", "example.org", "example.net")
PREFIXES = ("", "www.", "m.", "blog.")
PATHS = ("/en/12", "/fr/345.html", "/de/67/", "/es/890", "/article/3/page", "/")
TRAINED: dict[str, str] = {}  # models of this process's sessions


def labelled(spark: SparkSession, bad: tuple[str, ...] = BAD_WORDS, good: tuple[str, ...] = GOOD_WORDS) -> DataFrame:
    """``row, url, bad``: each word joined with others of its side (unwanted ones with two, plain ones with four, as they are
    more); prefix, domain and path go round on both sides alike. Unwanted hosts have a hyphen three times in four, plain
    ones one time in eight: hyphens in the host are a known mark of unwanted sites."""
    rows = []
    for words, label in ((bad, 1), (good, 0)):
        for k in range(len(words) * (2 if label else 4)):
            a, b = words[k % len(words)], words[(k + 1 + 6 * (k // len(words))) % len(words)]
            hyphen = k % 4 != 1 if label else k % 8 == 1
            rows.append((f"http{'s' * (k % 2)}://{PREFIXES[k // 2 % 4]}{a}{'-' * hyphen}{b}.{DOMAINS[k % 3]}{PATHS[k // 3 % 6]}", label))
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({k}, '{url}', {label})" for k, (url, label) in enumerate(rows)) + " AS labelled(row, url, bad)")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z in lower case; without ``://`` empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*+://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ``? #`` or the end; without ``://`` empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*+://[^/?#]*([^?#]*)", 1)


def slots(h: Column, p: Column) -> Column:
    """Distinct slots of the 1- to 5-grams of host and path, each between marks, sorted."""

    def grams(s: Column, mark: str) -> Column:
        marked = F.concat(F.lit(mark), s, F.lit("$"))
        n = F.length(marked)

        def of(k: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))
            each = F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(marked, i, F.lit(k))), F.lit(SLOTS)).cast("int"))
            return F.when(n >= k, each).otherwise(F.array().cast("array<int>"))

        return F.concat(*(of(k) for k in LENGTHS))

    return F.array_distinct(F.concat(grams(h, "^"), grams(p, "~")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.transform(F.array(value), use)[0]


def inner(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def train(spark: SparkSession, table: DataFrame | None = None) -> str:
    """Bias, then the weight of each slot, comma-separated: ``SLOTS`` + 1 numbers. The own table is learned once a session.

    Loss: logistic with L2 ``DECAY``, rows scaled to unit length. The labelled table is small and fixed;
    its Gram matrix is one row of ``rows * rows`` numbers, and the driver takes a number for each of its rows and slots."""
    own = spark.sparkContext.applicationId
    if table is None and own in TRAINED:
        return TRAINED[own]
    rows = labelled(spark) if table is None else table
    found = slots(host(F.col("url")), path(F.col("url")))
    t = rows.select("row", F.explode(found).alias("slot"), F.size(found).alias("n"))
    n = rows.count()
    left, right = t.alias("l"), t.alias("r")
    gram = left.join(right, "slot").groupBy(F.col("l.row").alias("i"), F.col("r.row").alias("j")).agg((F.count("*") / F.sqrt(F.first("l.n") * F.first("r.n"))).alias("k"))
    lines = gram.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "k"))).alias("found"))
    dense = lines.select("i", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(F.element_at("found", j), F.lit(0.0))).alias("line"))
    wanted = rows.select(F.col("row").alias("i"), F.col("bad").cast("double").alias("y"))
    whole = dense.join(wanted, "i").agg(F.array_sort(F.collect_list(F.struct("i", "y", "line"))).alias("rows"))

    def step(s: Column, _: Column) -> Column:
        """One step down the gradient: the bias and its speed, then a coefficient for each row and their speeds."""
        error = F.transform("rows", lambda r: r["y"] - 1 / (1 + F.exp(-s["bias"] - inner(r["line"], s["alpha"]))))

        def moved(e: Column) -> Column:
            turn = MOMENTUM * s["turn"] + 0.2 * RATE * F.aggregate(e, F.lit(0.0), lambda total, x: total + x) / n
            pull = F.zip_with(e, s["alpha"], lambda x, a: RATE * (x / n - DECAY * a))
            speed = F.zip_with(s["speed"], pull, lambda v, g: MOMENTUM * v + g)
            return let(speed, lambda v: F.struct((s["bias"] + turn).alias("bias"), turn.alias("turn"), F.zip_with(s["alpha"], v, lambda a, x: a + x).alias("alpha"), v.alias("speed")))

        return let(error, moved)

    zeros = F.array_repeat(F.lit(0.0), n)
    start = F.struct(F.lit(0.0).alias("bias"), F.lit(0.0).alias("turn"), zeros.alias("alpha"), zeros.alias("speed"))
    fitted = whole.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step).alias("s")).select("s.bias", "s.alpha").first()
    alpha = F.split(F.lit(",".join(map(repr, fitted["alpha"]))), ",").cast("array<double>")
    by_slot = t.groupBy("slot").agg(F.round(F.sum(F.element_at(alpha, F.col("row") + 1) / F.sqrt("n")), 9).alias("w"))
    got = {-1: fitted["bias"]} | {r["slot"]: r["w"] for r in by_slot.collect()}
    model = ",".join(repr(float(got.get(k, 0.0))) for k in range(-1, SLOTS))
    if table is None:
        TRAINED[own] = model
    return model


def rule(h: Column, p: Column) -> Column:
    """The longest rule ``(verdict, text)`` that fits, else null."""
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [((h == d) | h.endswith(f".{d}")) & p.startswith(q) for _, d, q in ordered]
    cases = [F.when(f, F.struct(F.lit(v).alias("verdict"), F.lit(d + q).alias("text"))) for f, (v, d, q) in zip(fits, ordered, strict=True)]
    return reduce(lambda a, b: F.coalesce(a, b), cases)


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", model: str | None = None, threshold: float = 0.5) -> DataFrame:
    """``id_col, host, path, rule, verdict, score`` for each row of ``df``.

    score: the model's odds that the url is unwanted, for every row; it decides (block at ``threshold``
    or more) where no rule fits. A null url or one without ``://`` has an empty host and path and is
    judged by the model's bias and the marks alone. Ids may be null or repeated; other columns are not
    read. One narrow pass after training."""
    spark = df.sparkSession
    w = F.split(F.lit(model or train(spark)), ",").cast("array<double>")
    at = df.select(df[id_col].alias("id"), host(df[url_col]).alias("h"), path(df[url_col]).alias("p")).withColumn("s", slots(F.col("h"), F.col("p")))
    margin = F.element_at(w, 1) + F.aggregate("s", F.lit(0.0), lambda a, k: a + F.element_at(w, k + 2)) / F.sqrt(F.greatest(F.size("s"), F.lit(1)))
    scored = at.select("id", "h", "p", rule(F.col("h"), F.col("p")).alias("r"), F.round(1 / (1 + F.exp(-margin)), 9).alias("score"))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), F.col("h").alias("host"), F.col("p").alias("path"), F.col("r.text").alias("rule"), verdict.alias("verdict"), "score")
