"""Operator 7 [native]: secret scans with a battery of randomness tests.

Base kinds are three patterns (assign, access, hex). The method adds kind `random`: tokens of TOKEN characters or more that
mix letters and digits. For each an encoding is inferred (hex, base32, base36, base62, base64) and tested for randomness over
that alphabet: Pearson's chi-squared for uniform symbols, runs above and below the alphabet's middle, and serial correlation
of neighbouring symbols. The least of the three p-values, times three, is the battery's.

Both of a token's hypotheses are decided by the Benjamini-Hochberg step, within its length class and over the tokens of the whole
table. The battery rejects "it is random" at level STRUCTURED: such a token has structure and is left, and of those left so at
most that share are random ones. "It is ordinary text" is a runs test too, of character classes: in ordinary text neighbouring
characters change class (digit, lower, upper, other) with probability ORDINARY at most, so k changes in n - 1 places have
p <= exp(-(n - 1) KL(k / (n - 1) | ORDINARY)) (Chernoff). It must be rejected at level FDR for a token to be found. p-values are
counted in bins; the bin's upper edge stands for its p.

Everything is DataFrame functions. Spans are code points, end exclusive. Places come from cutting the text at the matches:
gaps and matches in turn give all starts, added up in chunks of CHUNK matches and then over the chunks. Defined results: null and empty texts have no spans. Rows are scanned each on
its own, other columns are ignored, an empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

# Fixed values of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "random")

TOKEN = 20
RANDOM = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{%d,}" % TOKEN
STRUCTURED = 0.01
ORDINARY = 0.1
FDR = 0.01
CHUNK = 128
CLASSES = (20, 28, 40, 64)  #: least lengths of the length classes
BINS_PER_DECADE, MOST_BIN = 4, 1200

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = [  # name, pattern of the whole token, alphabet
    ("hex", "^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("HEX", "^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER),
    ("BASE36", "^[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", "", UPPER + LOWER + DIGITS + "+/"),  # - and _ count as + and /
]


def bound(x: Column, f) -> Column:
    """f(x), x computed once however often f uses it."""
    return F.transform(F.array(x), f)[0]


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches, leftmost and non-overlapping: array of (start, end, matched: the length of the group)."""
    p = F.lit(pattern)
    rows = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.length).alias("whole"),
        F.regexp_extract_all(text, p, F.lit(group)).alias("group"),
    )

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["whole"], F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["group"].alias("matched")))
        return F.struct(end.alias("at"), F.when(x["whole"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    chunks = lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / CHUNK)), lambda j: F.slice(r, (j * CHUNK + 1).cast("int"), F.lit(CHUNK)))
    length = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x["gap"] + F.coalesce(x["whole"], F.lit(0)))
    starts = lambda cs: F.aggregate(cs, F.array(F.lit(0)), lambda at, c: F.concat(at, F.array(F.element_at(at, -1) + length(c))))
    within = lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none().alias("out")), step, lambda acc: acc["out"])
    return bound(rows, lambda r: bound(chunks(r), lambda cs: F.flatten(F.zip_with(cs, F.slice(starts(cs), F.lit(1), F.size(cs)), within))))


def none() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,matched:string>>)")


def tail(z: Column) -> Column:
    """The upper tail of the normal distribution, for z >= 0 (to a few per cent)."""
    return F.lit(0.5) * F.exp(F.lit(-0.717) * z - F.lit(0.416) * z * z)


def tested(token: Column) -> Column:
    """(encoding, n, p_uniform, p_ordinary) of one token."""
    which = F.coalesce(*[F.when(token.rlike(p), F.lit(name)) for name, p, _ in ENCODINGS if p], F.lit(ENCODINGS[-1][0]))
    alphabets = F.create_map(*[F.lit(x) for name, _, alphabet in ENCODINGS for x in (name, alphabet)])
    base = F.struct(F.translate(token, "-_", "+/").alias("t"), F.length(token).alias("n"), which.alias("encoding"), alphabets[which].alias("alphabet"))
    classes = F.split(F.translate(token, DIGITS + LOWER + UPPER + "+/-_", "d" * 10 + "l" * 26 + "u" * 26 + "o" * 4), "")
    more = lambda b: F.struct(
        b["n"].cast("double").alias("n"),
        b["encoding"].alias("encoding"),
        F.length(b["alphabet"]).cast("double").alias("a"),
        F.transform(F.split(b["t"], ""), lambda c: (F.position(c, b["alphabet"]) - 1).cast("double")).alias("code"),
        F.transform(F.filter(F.split(b["alphabet"], ""), lambda c: c != ""), lambda c: (b["n"] - F.length(F.replace(b["t"], c, F.lit("")))).cast("double")).alias("count"),
        F.filter(classes, lambda c: c != "").alias("classes"),
    )

    def scored(m):
        n, a, code = m["n"], m["a"], m["code"]
        pairs = F.zip_with(F.slice(code, 1, (n - 1).cast("int")), F.slice(code, 2, (n - 1).cast("int")), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        add = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda s, x: s + f(x))
        far_off = 2 / (9 * (a - 1))  # the cube root of chi-squared is nearly normal (Wilson and Hilferty)
        chi = (F.cbrt(add(m["count"], lambda c: (c - n / a) * (c - n / a)) * a / n / (a - 1)) - 1 + far_off) / F.sqrt(far_off)
        runs = (add(pairs, lambda p: ((p["x"] < a / 2) != (p["y"] < a / 2)).cast("double")) - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        serial = add(pairs, lambda p: (p["x"] - (a - 1) / 2) * (p["y"] - (a - 1) / 2)) * 12 / (a * a - 1) / F.sqrt(n - 1)
        p_uniform = F.least(F.lit(1.0), 3 * F.least(tail(F.greatest(chi, F.lit(0.0))), 2 * tail(F.abs(runs)), 2 * tail(F.abs(serial))))
        kinds = m["classes"]
        changes = add(F.zip_with(F.slice(kinds, 1, (n - 1).cast("int")), F.slice(kinds, 2, (n - 1).cast("int")), lambda x, y: (x != y).cast("double")), lambda x: x)
        rate = changes / (n - 1)
        part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
        far = part(rate, F.lit(ORDINARY)) + part(1 - rate, F.lit(1 - ORDINARY))
        p_ordinary = F.when(rate > ORDINARY, F.exp(-(n - 1) * far)).otherwise(1.0)
        return F.struct(m["encoding"].alias("encoding"), n.cast("int").alias("n"), p_uniform.alias("p_uniform"), p_ordinary.alias("p_ordinary"))

    return bound(base, lambda b: bound(more(b), scored))


def length_class(n: Column) -> Column:
    out = F.lit(CLASSES[0])
    for c in CLASSES[1:]:
        out = F.when(n >= c, F.lit(c)).otherwise(out)
    return out


def bin_of(p: Column) -> Column:
    return F.least(F.lit(MOST_BIN), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * BINS_PER_DECADE)).cast("int")


def scanned(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id_col, the base spans and the tokens tested; texts are read once, and this is written."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(t)
    said = low.contains(KEYWORDS[0])
    for k in KEYWORDS[1:]:
        said = said | low.contains(k)
    keep = lambda kind, rows: F.filter(rows, lambda x: F.length(x["matched"]) >= LEAST[kind])
    # a text without a match of the least length has no span: the plain pattern need not run on it
    rows = docs.select(
        id_col,
        F.when(said, keep("assign", found(t, ASSIGN, 2))).otherwise(none()).alias("assign"),
        F.when(t.contains("AKIA"), keep("access", found(t, ACCESS))).otherwise(none()).alias("access"),
        F.when(t.rlike("[0-9a-f]{%d}" % LEAST["hex"]), keep("hex", found(t, "[0-9a-f]{%d,}" % LEAST["hex"]))).otherwise(none()).alias("hex"),
        F.when(t.rlike(RANDOM), found(t, RANDOM)).otherwise(none()).alias("tokens"),
    )
    return common.cut(rows.withColumn("tokens", F.transform("tokens", lambda x: F.struct(x["start"], x["end"], tested(x["matched"]).alias("test")))))


def cutoffs(rows: DataFrame) -> dict[str, dict[int, int]]:
    """For each p-value, length class to the least bin that the Benjamini-Hochberg step rejects; at most one entry per class."""
    levels = {"p_uniform": STRUCTURED, "p_ordinary": FDR}
    both = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), bin_of(F.col(f"t.{p}")).alias("b")) for p in levels]))
    tokens = rows.select(F.explode("tokens.test").alias("t")).select(length_class(F.col("t.n")).alias("c"), both.alias("x"))
    bins = tokens.groupBy("c", "x.p", "x.b").agg(F.count("*").alias("k"))
    as_small = F.sum("k").over(Window.partitionBy("c", "p").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0))
    bins = bins.withColumn("rank", as_small).withColumn("m", F.sum("k").over(Window.partitionBy("c", "p")))
    level = F.when(F.col("p") == "p_uniform", F.lit(levels["p_uniform"])).otherwise(F.lit(levels["p_ordinary"]))
    good = bins.where(F.pow(F.lit(10.0), -F.col("b") / BINS_PER_DECADE) <= level * F.col("rank") / F.col("m"))
    out: dict[str, dict[int, int]] = {p: {} for p in levels}
    for r in good.groupBy("c", "p").agg(F.min("b").alias("b")).collect():
        out[r.p][r.c] = r.b
    return out


def rejected(x: Column, p: str, least: dict[int, int]) -> Column:
    if not least:
        return F.lit(False)
    table = F.create_map(*[F.lit(v) for kv in least.items() for v in kv])
    return F.coalesce(bin_of(x["test"][p]) >= table[length_class(x["test"]["n"])], F.lit(False))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_assign, n_access, n_hex, n_random, base_sha256, spans (kind:start:end, by start, then kind as listed)."""
    rows = scanned(docs, id_col, text)
    least = cutoffs(rows)
    passes = lambda x: rejected(x, "p_ordinary", least["p_ordinary"]) & ~rejected(x, "p_uniform", least["p_uniform"])
    rows = rows.withColumn("random", F.filter("tokens", passes))
    told = lambda kind: F.transform(F.col(kind), lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), x["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))
    join = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.concat(*[told(k) for k in KINDS[:3]])
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select(id_col, *counts, F.sha2(join(base), 256).alias("base_sha256"), join(F.concat(base, told("random"))).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
