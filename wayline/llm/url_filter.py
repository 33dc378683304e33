"""URL verdicts with DataFrame functions only: rules for hosts and paths, and for the rest a logistic regression on
hashed character n-grams of host and path, trained from a small table of labelled URLs.

Training is a fold over an array: the labelled URLs fit into one row, and each round of gradient descent is a step that
alternates between the residuals of all URLs and the weights of all buckets. The table is a parameter of fixed size, so
this row doesn't grow with the pages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
BUCKETS = 1021
ROUNDS = 30
RATE = 0.03
RIDGE = 0.1
#: (pattern, verdict): a host, which also stands for its subdomains, and the beginning of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Words of URLs to block and of URLs to allow, and what stands in both; the labelled table is made of them.
BLOCKED = (
    "casino", "jackpot", "slots", "bonus", "poker", "bet", "pills", "meds", "loan", "payday", "prize", "winner", "claim", "crack", "keygen", "warez", "xxx", "cams",
    "dates", "spam", "farm", "backlinks", "popup", "ads", "redirect", "cheap", "replica", "miner", "lottery", "cash",
)
ALLOWED = (
    "library", "museum", "school", "recipes", "garden", "weather", "news", "science", "docs", "guide", "wiki", "forum", "travel", "health", "books", "journal", "city", "parks",
    "music", "theatre", "history", "physics", "courses", "articles", "archive", "catalog", "gallery", "novel", "forecast", "blog",
)
_NEUTRAL = (("", "en", "12"), ("www.", "de", "4711.html"), ("m.", "fr", "908"), ("blog.", "es", "35/"), ("the", "about", "2021/05"), ("site.", "page", "7?ref=x"))


def labelled_urls() -> list[tuple[str, int]]:
    """Some hundred labelled URLs (1: block), invented: each word with others of its kind, as host and as path, among
    parts that both kinds have; and names of syllables that mean nothing, which are allowed."""
    out = []
    for label, words in ((1, BLOCKED), (0, ALLOWED)):
        for i, word in enumerate(words):
            for k, step in enumerate((1, 4, 7, 11, 13, 17)):
                other, (sub, page, number) = words[(i + step) % len(words)], _NEUTRAL[(i + k) % len(_NEUTRAL)]
                host = (f"{word}-{other}", f"{word}", f"{word}{other}", f"{other}", f"{word}-{page}", f"host{(i * 7 + k) % 90}")[k]
                path = (f"{page}/{number}", f"{other}/{number}", f"{page}", f"{page}/{word}", f"{number}", f"{word}/{other}")[k]
                out.append((f"{'https' if (i + k) % 2 else 'http'}://{sub}{host}.example/{path}", label))
    syllables = [a + b for a in (*"bdfghklmnprstvw", "th", "st", "ch", "br") for b in ("a", "er", "in", "o", "ul", "es")]
    for i in range(180):
        name = "".join(syllables[(i * m + 5 * m) % len(syllables)] for m in (7, 11, 29)[: 2 + i % 2])
        sub, page, number = _NEUTRAL[i % len(_NEUTRAL)]
        out.append((f"{'https' if i % 2 else 'http'}://{sub}{name}.example/{page}/{i * 37 % 1000}{'' if i % 3 else '/' + number}", 0))
    return out


LABELLED = tuple(labelled_urls())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or URL."""
    return F.translate(F.regexp_extract(_after(url), r"(?s)\A([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"(?s)\A[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.position(F.lit("://"), url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def buckets(host: Column, path: Column) -> Column:
    """The bucket of each n-gram of characters of host + path, in order; bucket 0, the constant, is not among them."""
    code = F.transform(F.regexp_extract_all(F.concat(host, path), F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c).cast("long"))
    return F.flatten(F.transform(F.array(code), lambda b: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(b) - (GRAM - 1), F.lit(1))), lambda i: i <= F.size(b) - (GRAM - 1)),
        lambda i: ((F.element_at(b, i) * 961 + F.element_at(b, i + 1) * 31 + F.element_at(b, i + 2)) % BUCKETS + 1).cast("int"),
    )))


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _score(weights: Column, own: Column) -> Column:
    return F.aggregate(own, F.element_at(weights, 1), lambda z, b: z + F.element_at(weights, b + 1))


def train(spark: SparkSession, labelled: Sequence[tuple[str, int]] = LABELLED, rounds: int = ROUNDS, rate: float = RATE, ridge: float = RIDGE) -> list[float]:
    """The weights of all buckets, the constant first. Without labelled URLs all of them are 0."""
    if not labelled:
        return [0.0] * (BUCKETS + 1)
    rows = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(labelled)], "i int, url string, y int")
    own = rows.select("i", "y", buckets(host_of(F.col("url")), path_of(F.col("url"))).alias("own"))
    urls = own.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "y", "own"))), lambda r: F.struct(r["y"].alias("y"), r["own"].alias("own"))).alias("urls"))
    places = own.select("i", F.explode(F.concat(F.array(F.lit(0)), "own")).alias("bucket")).groupBy("bucket").agg(F.sort_array(F.collect_list("i")).alias("of"))
    every = spark.range(BUCKETS + 1).select(F.col("id").cast("int").alias("bucket")).join(places, "bucket", "left")
    inverse = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("of", F.array().cast("array<int>")).alias("of")))), lambda r: r["of"]).alias("inverse"))

    def step(state: Column, k: Column) -> Column:
        rest = F.transform("urls", lambda r: r["y"] - _sigmoid(_score(state["w"], r["own"])))
        moved = F.zip_with(state["w"], F.col("inverse"), lambda w, of: w + rate * (F.aggregate(of, F.lit(0.0), lambda a, i: a + F.element_at(state["rest"], i + 1)) - ridge * w))
        return F.when(k % 2 == 1, F.struct(state["w"].alias("w"), rest.alias("rest"))).otherwise(F.struct(moved.alias("w"), state["rest"].alias("rest")))

    start = F.struct(F.array_repeat(F.lit(0.0), BUCKETS + 1).alias("w"), F.array_repeat(F.lit(0.0), len(labelled)).alias("rest"))
    made = urls.join(F.broadcast(inverse)).select(F.aggregate(F.sequence(F.lit(1), F.lit(2 * rounds)), start, step)["w"].alias("w"))
    return list(made.first()["w"])


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, int]] = LABELLED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict, score.

    The longest rule that fits decides; of equally long ones, which then differ in the split of host and path, the last
    in alphabetical order. Without a rule the verdict is block where the regression's score is 0.5 or more. A null URL,
    or one without ``://``, has an empty host and path and is judged by the constant alone. Null ids and repeated rows
    are judged like others; an empty table gives an empty result; other columns are ignored.
    """
    weights = F.array(*[F.lit(w) for w in train(pages.sparkSession, labelled)])
    split = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = F.array(*[
        F.struct(F.lit(len(p)).alias("size"), F.lit(p).alias("rule"), F.lit(p.partition("/")[0]).alias("host"), F.lit("/" + p.partition("/")[2]).alias("path"), F.lit(v).alias("verdict"))
        for p, v in rules
    ]) if rules else F.array().cast("array<struct<size:int,rule:string,host:string,path:string,verdict:string>>")
    fits = F.filter(known, lambda r: ((F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))) & F.startswith(F.col("path"), r["path"]))
    judged = split.withColumns({"best": F.array_max(fits), "score": _sigmoid(_score(weights, buckets(F.col("host"), F.col("path"))))})
    return judged.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score",
    )


def plain_weights(labelled: Sequence[tuple[str, int]] = LABELLED, rounds: int = ROUNDS, rate: float = RATE, ridge: float = RIDGE) -> list[float]:
    """The weights of :func:`train` by plain loops, for the SQL that the query is compared with."""
    import math

    def own(url: str) -> list[int]:
        rest = url.partition("://")[2]
        host = rest[: min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))]
        path = rest[len(host) :]
        path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
        b = [ord(c) for c in host.translate(str.maketrans(_UPPER, _LOWER)) + path]
        return [(b[i] * 961 + b[i + 1] * 31 + b[i + 2]) % BUCKETS + 1 for i in range(len(b) - 2)]

    rows = [(y, [0, *own(u)]) for u, y in labelled]
    w = [0.0] * (BUCKETS + 1)
    for _ in range(rounds):
        slope = [0.0] * len(w)
        for y, f in rows:
            rest = y - 1 / (1 + math.exp(-sum(w[b] for b in f)))
            for b in f:
                slope[b] += rest
        w = [x + rate * (s - ridge * x) for x, s in zip(w, slope, strict=True)]
    return w
