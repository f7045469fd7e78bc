"""Secret scans with a randomness test battery, in built-in functions only.

Base spans come from three patterns: assignments to secret names, access key ids, and long hex
digits. The battery adds tokens that look drawn at random. A token's encoding is inferred from
its characters (hex, base 32, base 36, base 64), and its symbols' numbers are tested for a
uniform alphabet (chi-squared), for runs above and below the alphabet's middle, and for serial
correlation. The smallest of the three probabilities, corrected for three tries, is the token's
randomness: even over 0 to 1 for random tokens, near 0 for words, the nearer the longer.

False discoveries are held down by length. Random tokens are even over randomness, so those that
pass a level tell how many of a class are random and how many are not. Tokens without a digit or
without a letter are decoys, which tell what share of the others that are not random passes; the
decoys that random tokens make by chance are taken off, and a share that was measured on source
code stands in as far as there are no decoys. For each encoding and class of length the lowest
level is taken at which this share of the tokens that are not random is at most RATE of those
found. Long decoys have a level of their own, by the fixed share. All this hangs on shares of
tokens, never on their number. Classes and levels are few, so this table is collected and goes
back as a literal; the texts are scanned once for it and once for the result, without a shuffle
of rows.

Spans are in characters (code points), the end exclusive. Defined results: null texts are
empty; without any span the joined string is empty; very long texts are scanned whole; rows repeat
as given, and a table repeated any number of times has the same spans; an empty table gives no
rows; columns named base and spans are replaced by scan, others stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Kinds in their order; pattern, and how long the group has to be.
BASE = (("assign", ASSIGN, 1, 12), ("access", r"AKIA[A-Z0-9]{14,}", 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 16))
RANDOM = "random"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
LEVELS, LENGTHS, RATE = 20, 24, 0.05
#: Share of source code's decoys that pass the first level, by class of length (8: 20 to 22, 9: 23 to 31, then all): CPython's library.
PRIOR = {8: 0.18, 9: 0.03, 10: 0.002}
#: So many decoys for each token are taken to have passed at PRIOR's rate.
WEIGHT = 0.05
#: From this class of length on (32 characters) decoys can be found as well.
LONG = 10
#: What is added to the class of a decoy.
DECOY = len(ALPHABETS) * LENGTHS
#: Lengths that are summed in one go.
CHUNK = 256


def before(lengths: Column) -> Column:
    """For each length, the sum of all lengths before it; chunk by chunk, so not in square time."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + x)

    def sums(all_: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda c: total(F.slice(all_, c * CHUNK + 1, F.lit(CHUNK))))
        starts = F.aggregate(chunks, F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
        one = lambda c, start: F.transform(
            F.sequence(F.lit(0), F.least(F.lit(CHUNK), F.size(all_) - c * CHUNK) - 1),
            lambda i: start + total(F.slice(all_, c * CHUNK + 1, i)),
        )
        return let(starts, lambda st: F.flatten(F.transform(F.slice(st, F.lit(1), F.size(st) - 1), lambda start, c: one(c, start))))

    return F.when(F.size(lengths) > 0, let(lengths, sums)).otherwise(F.array().cast("array<bigint>"))


def matches(text: Column, pattern: str, group: int) -> Column:
    """array of (start, end, value) of all matches, leftmost first; value is the group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    # between two matches stands a piece of the split; piece and match take turns
    pieces = F.split(text, pattern, -1)
    turns = F.zip_with(F.slice(pieces, F.lit(1), F.size(whole)), whole, lambda p, m: F.struct(F.length(p).cast("long").alias("gap"), F.length(m).cast("long").alias("n")))
    starts = let(turns, lambda t: F.zip_with(before(F.transform(t, lambda x: x['gap'] + x['n'])), t, lambda s, x: F.struct((s + x['gap']).alias("start"), (s + x['gap'] + x['n']).alias("end"))))
    both = F.zip_with(starts, values, lambda s, v: F.struct(s['start'].alias("start"), s['end'].alias("end"), v.alias("value")))
    return F.when(F.size(whole) > 0, both).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))


def normal(z: Column) -> Column:
    """The normal distribution's share below z, to about 1e-4."""
    return 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def battery(codes: Column, size: Column) -> Column:
    """Randomness of a token's symbol numbers (0 to size - 1)."""
    zero = F.lit(0.0)
    n = F.size(codes).cast("double")
    upper = lambda x: F.when(x * 2 >= size, 1.0).otherwise(0.0)
    squares = F.aggregate(
        F.array_sort(codes),
        F.struct(F.lit(-1).alias("last"), zero.alias("run"), zero.alias("sum")),
        lambda s, x: F.struct(
            x.alias("last"),
            F.when(x == s["last"], s["run"] + 1.0).otherwise(1.0).alias("run"),
            (s["sum"] + F.when(x == s["last"], 2.0 * s["run"] + 1.0).otherwise(1.0)).alias("sum"),
        ),
        lambda s: s["sum"],
    )
    # cube root of chi-squared over its freedom is near normal
    share = 2.0 / (9.0 * (size - 1.0))
    uniform = 1.0 - normal((F.cbrt(F.greatest(size / n * squares - n, zero) / (size - 1.0)) - (1.0 - share)) / F.sqrt(share))
    pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    high = F.aggregate(codes, zero, lambda s, x: s + upper(x))
    runs = F.aggregate(pairs, F.lit(1.0), lambda s, x: s + F.abs(upper(x["a"]) - upper(x["b"])))
    mean = F.aggregate(codes, zero, lambda s, x: s + x, lambda s: s / n)

    def two_sided(z: Column) -> Column:
        return 2.0 * (1.0 - normal(F.least(F.abs(z), F.lit(20.0))))

    by_runs = let(high, lambda h: let(2.0 * h * (n - h) / n + 1.0, lambda e: two_sided((runs - e) / F.sqrt(F.greatest((e - 1.0) * (e - 2.0) / (n - 1.0), F.lit(1e-9))))))
    by_serial = let(
        mean,
        lambda m: two_sided(
            (F.aggregate(pairs, zero, lambda s, x: s + (x["a"] - m) * (x["b"] - m)) / F.greatest(F.aggregate(codes, zero, lambda s, x: s + (x - m) * (x - m)), F.lit(1e-9)) + 1.0 / n)
            * F.sqrt(n)
        ),
    )
    return 1.0 - F.pow(1.0 - F.greatest(F.least(uniform, by_runs, by_serial), zero), F.lit(3.0))


def tokens(text: Column) -> Column:
    """array of (start, end, decoy, class, level): candidates, their class of encoding and length, and their randomness in steps."""
    alphabets = list(ALPHABETS.values())

    def judge(m: Column) -> Column:
        t = m["value"]
        kind = F.when(t.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 0).when(t.rlike("^[A-Z2-7]+$"), 1).when(t.rlike("^[a-z0-9]+$"), 2).otherwise(3)

        def scored(k: Column) -> Column:
            plain = F.when(k == 0, F.lower(t)).when(k == 3, F.translate(t, "-_", "+/")).otherwise(t)
            letters = reduce(lambda w, i: w.when(k == i, F.lit(alphabets[i])), (1, 2, 3), F.when(k == 0, F.lit(alphabets[0])))
            codes = F.transform(F.split(plain, ""), lambda c: F.position(c, letters) - 1)
            return F.struct(
                m["start"].alias("start"),
                m["end"].alias("end"),
                (~t.rlike("[0-9]") | ~t.rlike("[A-Za-z]")).alias("decoy"),
                (k * LENGTHS + F.least(F.floor(2 * F.log2(F.length(t))), F.lit(LENGTHS - 1))).cast("int").alias("class"),
                F.least(F.floor(let(codes, lambda c: battery(c, F.length(letters).cast("double"))) * LEVELS), F.lit(LEVELS - 1)).cast("int").alias("level"),
            )

        return let(kind, scored)

    return F.transform(matches(text, TOKEN, 0), judge)


def prior(c: int, level: int) -> float:
    """Share of tokens of a class that are not random but pass the level."""
    return PRIOR[min(max(c % LENGTHS, min(PRIOR)), max(PRIOR))] * (1 - level / LEVELS) ** 2


def lowest(counts: list[float], share) -> int | None:
    """The lowest level at which false ones are at most RATE of those found; share(level) of those not random pass."""
    n = sum(counts)
    for level in range(1, LEVELS):
        found, even, false = sum(counts[level:]), 1 - level / LEVELS, share(level)
        other = n if false >= even else min(n, max(0.0, (n * even - found) / (even - false)))
        if found and other * false <= RATE * found:
            return level
    return None


def least_levels(docs: DataFrame) -> dict[int, int]:
    """For each class, the lowest level that counts as random; decoys' classes are DECOY more."""
    # decoys that random tokens make, for each one that isn't a decoy
    letters = F.element_at(F.array(*(F.lit(sum(not x.isdigit() for x in a) / len(a)) for a in ALPHABETS.values())), F.expr(f"cast(t.class div {LENGTHS} as int) + 1"))
    chance = let(F.pow(letters, F.col("t.end") - F.col("t.start")), lambda q: q / (1.0 - q))
    found = docs.select(F.explode(tokens(F.col("text").cast("string"))).alias("t")).groupBy("t.class", "t.level", "t.decoy").agg(F.count("*").alias("n"), F.sum(chance).alias("chance"))
    decoys, others, by_chance = {}, {}, {}
    for r in found.collect():  # classes x levels rows
        (decoys if r["decoy"] else others).setdefault(r["class"], [0] * LEVELS)[r["level"]] += r["n"]
        if not r["decoy"]:
            by_chance.setdefault(r["class"], [0.0] * LEVELS)[r["level"]] += r["chance"]
    least = {}
    for c, counts in decoys.items():
        if c % LENGTHS >= LONG and (level := lowest(counts, lambda at: prior(c, at))):  # noqa: B023
            least[c + DECOY] = level
    for c, counts in others.items():
        alike = [k for k in decoys.keys() | others.keys() if k // LENGTHS == c // LENGTHS and k <= c]
        everyone = sum(sum(decoys.get(k, ())) for k in alike)

        def share(level: int) -> float:
            passing = 0.0
            for k in alike:  # noqa: B023
                passed = sum(decoys.get(k, [0])[level : least.get(k + DECOY, LEVELS)])
                passing += max(0.0, passed - sum(by_chance.get(k, [0.0])[level:]))
            pseudo = WEIGHT * sum(counts)  # noqa: B023
            return (passing + pseudo * prior(c, level)) / (everyone + pseudo)  # noqa: B023

        if level := lowest(counts, share):
            least[c] = level
    return least


def base_spans(text: Column) -> Column:
    """array of (start, kind, end, name), kinds as in BASE; in the order of start and kind."""


    def of(number: int, name: str, pattern: str, group: int, least: int) -> Column:
        found = F.filter(matches(text, pattern, group), lambda m: F.length(m["value"]) >= least)
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end"), F.lit(name).alias("name")))

    return F.array_sort(F.concat(*(of(i, *kind) for i, kind in enumerate(BASE))))


def scan(docs: DataFrame, levels: dict[int, int] | None = None) -> DataFrame:
    """docs with base and spans, arrays of (start, kind, end, name), in place of columns of these names.

    spans are the base ones and the battery's that overlap none of them.
    """
    levels = least_levels(docs) if levels is None else levels
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [c for c in docs.columns if c not in ("base", "spans")]
    based = docs.select(*kept, base_spans(text).alias("base"))

    def random(base: Column) -> Column:
        def good(t: Column) -> Column:
            enough = F.lit(False)
            for c, level in sorted(levels.items()):
                enough = enough | ((t["class"] == c % DECOY) & (t["decoy"] == (c >= DECOY)) & (t["level"] >= level))
            return enough & ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))

        added = F.transform(F.filter(tokens(text), good), lambda t: F.struct(t["start"].alias("start"), F.lit(len(BASE)).alias("kind"), t["end"].alias("end"), F.lit(RANDOM).alias("name")))
        return F.array_sort(F.concat(base, added))

    return based.withColumn("spans", let(F.col("base"), random))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")


def report(docs: DataFrame, levels: dict[int, int] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of docs."""
    found = scan(docs.select("doc_id", "text"), levels)
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{name}") for i, (name, *_) in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of text replaced by mask; overlapping spans by one. A null text stays null."""
    found = scan(docs)
    text = F.col("text").cast("string")
    # what stands between the unions of spans, each followed by the mask, and the rest
    walked = F.aggregate(
        "spans",
        F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("to")),
        lambda s, x: F.when(x["end"] <= s["to"], s).otherwise(
            F.struct(
                F.when((x["start"] < s["to"]) & (s["to"] > 0), s["parts"])
                .otherwise(F.concat(s["parts"], F.array(F.substring(text, (s["to"] + 1).cast("int"), (x["start"] - s["to"]).cast("int")), F.lit(mask))))
                .alias("parts"),
                x["end"].alias("to"),
            )
        ),
        lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, (s["to"] + 1).cast("int"), F.length(text))),
    )
    return found.select(*[F.when(F.size("spans") > 0, walked).otherwise(text).alias("text") if c == "text" else F.col(c) for c in docs.columns])
