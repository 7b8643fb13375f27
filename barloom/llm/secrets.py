"""Secret scans: plain patterns, and character Markov models for what they miss.

Two first-order Markov models over characters, one of random strings and one of ordinary identifiers, are estimated from
labelled samples: generated ones of both kinds, and as ordinary every word that the documents have several times. A
token whose log-likelihood ratio speaks for the random one is a secret. Everything is built from DataFrame and SQL functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns, each with the shortest match (of group 2 for assign) that counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_CHARS = 8
#: In lower case; each match of ASSIGN holds one.
ASSIGN_PARTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# A greedy run of at least so many characters is the same as a greedy run that is then measured.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

#: Characters with a state of their own; all others share one.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
#: A token is a whole run of the alphabet's characters of this length or more; shorter ones say too little for a verdict.
TOKEN_CHARS = 16
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{TOKEN_CHARS},}}+"
#: Elements that are summed one by one; the sums of blocks of them are then summed.
BLOCK = 128

#: Words that the ordinary identifiers of the built-in samples are made of.
PLAIN_WORDS = (
    "get set user name value index count data list item node tree parse render update delete create handler request response server client config default option "
    "buffer stream reader writer parser builder factory manager service controller session table column query result error message event state button label image layout window container"
).split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pairs_of(text: Column) -> Column:
    """The pairs of neighbouring characters, each as one number. Takes time in proportion to the text."""
    table = F.array(*[F.lit(ALPHABET.find(chr(c)) + 1) for c in range(128)])
    states = F.transform(F.split(text, ""), lambda c: F.coalesce(F.get(table, F.ascii(c)), F.lit(0)))
    return let(states, lambda s: F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s)), lambda x, y: x * STATES + y))


def before_each(values: Column) -> Column:
    """For each of an array's integers the sum of those before it; in blocks, so that a long array doesn't cost its square."""
    upto = lambda x, n: F.aggregate(F.slice(x, F.lit(1), n), F.lit(0), lambda a, v: a + v)
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(x), F.lit(1)) - 1) / BLOCK).cast("int")), lambda k: F.slice(x, k * BLOCK + 1, F.lit(BLOCK)))

    def whole(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, v: a + v))
        starts = let(sums, lambda t: F.transform(t, lambda _, k: upto(t, k)))
        return F.flatten(F.zip_with(blocks, starts, lambda b, s: F.transform(b, lambda _, i: s + upto(b, i))))

    return let(let(values, cut), whole)


def builtin_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(text, random): n labelled strings of each class, the same at every call."""
    ids = spark.range(n).select(F.col("id").cast("string").alias("id"), (F.col("id") % 8).alias("way"))
    digest = lambda tag: F.sha2(F.concat(F.lit(f"{tag}:"), F.col("id")), 256)
    base64 = F.base64(F.unhex(digest("r")))
    random = ids.select(
        F.when(F.col("way") == 0, F.substring(digest("r"), 1, 40))
        .when(F.col("way") == 1, F.upper(F.substring(base64, 1, 32)))
        .when(F.col("way") < 4, F.translate(base64, "+/=", "xYz"))
        .when(F.col("way") < 6, F.translate(base64, "+/=", "-_"))
        .otherwise(base64)
        .alias("text"),
        F.lit(1).alias("random"),
    )
    words = F.split(F.lit(" ".join(PLAIN_WORDS)), " ")
    number_in = lambda k, n: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(n))
    word = lambda k: F.element_at(words, (number_in(k, len(PLAIN_WORDS)) + 1).cast("int"))
    number = number_in("n", 100).cast("string")
    date = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), number_in("d", 10_000).cast("int")), "yyyy-MM-dd")
    ruler = F.repeat(F.element_at(F.split(F.lit("- = _ / + x X 0"), " "), (number_in("c", 8) + 1).cast("int")), 30)
    plain = ids.select(
        F.when(F.col("way") == 0, F.concat_ws("_", word(1), word(2), word(3), word(4)))
        .when(F.col("way") == 1, F.concat(word(1), F.initcap(word(2)), F.initcap(word(3)), F.initcap(word(4))))
        .when(F.col("way") == 2, F.concat_ws("/", word(1), F.concat(word(2), F.lit("-"), word(3)), word(4)))
        .when(F.col("way") == 3, F.concat(F.upper(F.concat_ws("_", word(1), word(2))), F.lit("_"), number))
        .when(F.col("way") == 4, F.concat_ws("-", word(1), date, word(2), number))
        .when(F.col("way") == 5, F.concat(word(1), F.lit("="), F.rpad(number_in("l", 1 << 40).cast("string"), 20, "0"), F.lit("/"), F.initcap(word(2)), word(3), number))
        .when(F.col("way") == 6, F.concat(F.translate(date, "-", ""), number_in("l", 1 << 40).cast("string"), F.lit("-"), number, F.lit("-"), number_in("m", 1 << 30).cast("string")))
        .otherwise(ruler)
        .alias("text"),
        F.lit(0).alias("random"),
    )
    return random.unionByName(plain)


def corpus_words(docs: DataFrame, least: int = 3, text_col: str = "text") -> DataFrame:
    """(text, random=0): each word of 4 to 24 letters that all documents have together at least `least` times, once. Labelled as ordinary."""
    parts = F.filter(F.split(text_col, "[^A-Za-z]+"), lambda w: F.length(w).between(4, 24))
    words = docs.select(F.explode(parts).alias("text"))
    return words.groupBy("text").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("text", F.lit(0).alias("random"))


def fit_ratios(samples: DataFrame) -> list[float]:
    """log P(next | this, random) - log P(next | this, ordinary) for each pair of states, row by row, smoothed by a half.

    samples: (text, random 0/1). Only STATES x STATES sums reach the driver. Without samples all ratios are 0.
    """
    pairs = samples.where(F.length("text") > 1).select("random", F.explode(pairs_of(F.col("text"))).alias("pair"))
    counts = [[0.0] * (STATES * STATES) for _ in range(2)]
    for r in pairs.groupBy("random", "pair").count().collect():
        counts[r["random"]][r["pair"]] = float(r["count"])

    def log_p(c: list[float], pair: int) -> float:
        row = pair // STATES * STATES
        return math.log((c[pair] + 0.5) / (sum(c[row : row + STATES]) + 0.5 * STATES))

    return [log_p(counts[1], p) - log_p(counts[0], p) for p in range(STATES * STATES)]


def log_ratio(token: Column, ratios: list[float]) -> Column:
    """The sum of the ratios over a token's pairs of characters."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    return F.aggregate(pairs_of(token), F.lit(0.0), lambda a, pair: a + F.get(table, pair))


def matches(text: Column, pattern: str, kind: int, value_group: int, counts: Callable[[Column], Column], when: Column) -> Column:
    """array<struct(start, kind, end, value)> of the matches that count: code points, end exclusive. None are looked for where `when` is false.

    Positions come from the lengths of the pieces between the matches.
    """
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    both = F.arrays_zip(whole.alias("m"), F.regexp_extract_all(text, p, F.lit(value_group)).alias("v")) if value_group else F.transform(whole, lambda m: F.struct(m.alias("m"), m.alias("v")))
    steps = F.zip_with(F.split(text, pattern, -1), both, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b["m"]).alias("n"), b["v"].alias("v")))
    steps = F.filter(steps, lambda s: s["n"].isNotNull())

    def spans(s: Column) -> Column:
        def span(x: Column, at: Column) -> Column:
            start = at + x["gap"]
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["n"]).alias("end"), x["v"].alias("value"))

        return F.filter(F.zip_with(s, before_each(F.transform(s, lambda x: x["gap"] + x["n"])), span), lambda x: counts(x["value"]))

    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return F.coalesce(F.when(when, let(steps, spans)), none)


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others. spans: sorted, and none over another.

    A span is overlapped if more of the others start before its end than end at its start or before. Both numbers are places in a sorted
    array, so that this takes no longer than sorting does.
    """

    def earlier(at: str, other_at: str, ties_first: bool) -> Column:
        own = F.transform(spans, lambda s: F.struct(s[at].alias("at"), F.lit(1).alias("side")))
        rest = F.transform(others, lambda s: F.struct(s[other_at].alias("at"), F.lit(0 if ties_first else 2).alias("side")))
        places = F.transform(F.array_sort(F.concat(own, rest)), lambda e, i: F.struct(e["side"].alias("side"), i.alias("i")))
        return F.transform(F.filter(places, lambda e: e["side"] == 1), lambda e, j: e["i"] - j)

    marked = F.arrays_zip(spans.alias("s"), earlier("end", "start", False).alias("a"), earlier("start", "end", True).alias("b"))
    return F.transform(F.filter(marked, lambda x: x["a"] <= x["b"]), lambda x: x["s"])


def scan_secrets(docs: DataFrame, ratios: list[float], least_ratio: float = 10.0, least_mean: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base (spans of the patterns) and added (spans of the models), arrays of struct(start, kind, end, value).

    Both are sorted by start, then kind; kind is the place in KINDS. A token is added where its log ratio is at least
    least_ratio, and least_mean a pair of characters, and it overlaps no base span. Null and empty texts have no spans; equal texts have equal
    ones. Ids may repeat or be null, an empty table gives an empty one, and no other column is read. A text of any length is read in time in proportion to
    it, but for the sorting of its spans.
    """
    text, runs = F.coalesce(F.col("_text"), F.lit("")), F.col("_runs")
    out = docs.select(id_col, F.col(text_col).alias("_text"))
    # What is looked for is in few texts. A run of the tokens' characters holds every match of access and hex, and a part of a word every one of assign.
    out = out.withColumns({"_runs": F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), "_lower": F.lower(text)})
    assigned = F.lit(False)
    for part in ASSIGN_PARTS:
        assigned = assigned | F.col("_lower").contains(part)
    in_runs = lambda pattern: F.exists(runs, lambda r: r.rlike(pattern))
    out = out.withColumn("_says", F.when(F.size(runs) > 0, F.transform(runs, lambda v: let(log_ratio(v, ratios), lambda r: (r >= least_ratio) & (r >= least_mean * (F.length(v) - 1))))))
    base = F.concat(
        matches(text, ASSIGN, 0, 2, lambda v: F.length(v) >= ASSIGN_CHARS, assigned),
        matches(text, ACCESS, 1, 0, lambda v: F.lit(True), in_runs(ACCESS)),
        matches(text, HEX, 2, 0, lambda v: F.lit(True), in_runs(HEX)),
    )
    tokens = matches(text, TOKEN, 3, 0, lambda v: F.lit(True), F.exists("_says", lambda x: x))
    tokens = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), F.col("_says").alias("y")), lambda x: x["y"]), lambda x: x["t"])
    out = out.withColumns({"base": F.array_sort(base), "_tokens": F.coalesce(F.when(F.exists("_says", lambda x: x), tokens), F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))})
    free = F.when((F.size("_tokens") > 0) & (F.size("base") > 0), apart(F.col("_tokens"), F.col("base"))).otherwise(F.col("_tokens"))
    return out.select(id_col, "base", free.alias("added"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
