"""Secret scan: three fixed patterns, and a randomness battery over what they leave.

All of it is DataFrame functions. Positions come from cutting the text at a pattern's
matches: a match starts after the pieces and matches before it (code points).

The battery looks at runs of 20 or more token characters with a letter and a digit.
The narrowest alphabet that fits gives the encoding (hex, base32, base36, base62,
base64). Were the run uniform over its alphabet, then

* the chi-squared statistic of symbol counts has mean ``k - 1`` and variance
  ``2 (k - 1) (n - 1) / n``,
* the number of changes between the lower and upper half of the alphabet is
  binomial ``(n - 1, 1/2)``,
* the lag-1 product of centred symbol values has mean 0 and variance ``1 / (n - 1)``;

the three p-values are joined by Fisher's method. Random strings have evenly spread
p-values, text piles up near 0. So within each (encoding, length class) the p-values
above 1/2 tell how many of the candidates are random, and with that the share of
false discoveries among the candidates above any bar. The bar is the lowest that keeps
this share at ``fdr`` (with one standard error to be safe); classes are doubled
lengths by half steps, so short strings, which text passes by chance, face a higher
bar. A class too small to tell starts from a fixed bar, the one that holds a share of
1/20 among as many texts of its length as random strings (``BY_CHANCE``), and keeps it
unless its own counts say otherwise: a lone random string is found. A string counts once,
however many documents hold it. The count by class
and hundredth of p is all that leaves the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import MAXIMUM, STRIDE, running
from .common import staged

# The three base kinds, in their order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
#: Shorter hex runs fail anyway; a pattern that skips them finds the same long ones.
HEX_LONG = r"(?<![0-9a-f])[0-9a-f]{32,}+"

#: "=" only as padding at the end: a value after NAME= is a run of its own.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:=++(?![A-Za-z0-9+/_-]))?+"
FDR = 0.05
FLOOR = 0.01
PLACEHOLDER = "[SECRET]"

# Alphabets of the encodings, narrowest first (name, members, symbols in order).
ALPHABETS = [
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[0-9A-Za-z+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
]

# For the length classes from 8 (20 characters) on, the bar where a random string is 19 times
# as likely as a text, and the share of texts with p of 1/2 or more; later classes: FLOOR and none. From
# 6,000 to 20,000 made-up texts a class: words of sf0.1 joined by - or / (base64), in camel case (base62), run
# together (base36, base32), all with a number; decimal numbers with a letter between (hex).
BY_CHANCE = {
    "hex": [(0.77, 0.0675), (0.43, 0.0195), (0.14, 0.0023), (0.02, 0.0)],
    "base32": [(0.35, 0.0152), (0.10, 0.0036), (0.01, 0.0001)],
    "base36": [(0.45, 0.0208), (0.17, 0.0062), (0.02, 0.0003)],
    "base64": [(0.04, 0.0003)],
}
FIRST_CLASS = 8

_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _sql(pattern: str) -> str:
    """A string literal of SQL."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _cut(text: str, pattern: str, group: int = 0) -> str:
    """SQL: array of (start, end, g) of every match, leftmost and non-overlapping; g is the group."""
    p = _sql(pattern)
    found, pieces, groups = f"regexp_extract_all({text}, {p}, 0)", f"split({text}, {p}, -1)", f"regexp_extract_all({text}, {p}, {group})"
    sizes = f"zip_with({found}, slice({pieces}, 1, size({groups})), (m, x) -> struct(cast(length(m) as bigint) as size, cast(length(x) as bigint) as gap))"
    zipped = f"zip_with({sizes}, {groups}, (a, g) -> struct(a.size as size, a.gap as gap, g as g))"
    placed = f"zip_with(m, {running('m', 'e.gap + e.size')}, (x, at) -> struct(at + x.gap as start, at + x.gap + x.size as end, x.g as g))"
    return f"if({text} rlike {p}, element_at(transform(array({zipped}), m -> {placed}), 1), cast(array() as array<struct<start:bigint,end:bigint,g:string>>))"


def _kind(text: str, rank: int, kind: str, pattern: str, least: int, group: int = 0) -> str:
    return f"transform(filter({_cut(text, pattern, group)}, m -> length(m.g) >= {least}), m -> struct(m.start as start, {rank} as rank, m.end as end, '{kind}' as kind))"


def _tail(z: str) -> str:
    """SQL: P(N > z) for a standard normal, good to 1e-7 (a rational form of the complementary error function)."""
    # Coefficients of the approximation, highest power first.
    terms = [0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223]
    poly = "0.0"
    for c in terms:
        poly = f"({c} + t * {poly})"
    t = f"(1 / (1 + 0.5 * abs({z}) / sqrt(2D)))"
    half = f"0.5 * element_at(transform(array({t}), t -> t * exp(-pow({z}, 2) / 2 + {poly})), 1)"
    return f"(case when {z} >= 0 then {half} else 1 - {half} end)"


def _battery(cut: str) -> str:
    """SQL: array of (start, end, enc, n, id, p) of the candidates that could be encoded secrets."""
    kinds = " ".join(f"when b rlike '{member}' then '{name}'" for name, member, _ in ALPHABETS)
    symbols = " ".join(f"when '{name}' then '{letters}'" for name, _, letters in ALPHABETS)
    body = r"translate(regexp_replace(c.g, '=+$', ''), '-_', '+/')"
    steps = [
        ("c", f"struct(c.start, c.end, {body} as b)"),
        ("c", f"struct(c.start, c.end, c.b, element_at(transform(array(c.b), b -> case {kinds} end), 1) as enc)"),
        ("c", f"struct(c.start, c.end, c.b, c.enc, case c.enc {symbols} end as letters)"),
        ("c", "struct(c.start, c.end, c.b, c.enc, c.letters, transform(regexp_extract_all(c.b, '.', 0), x -> instr(c.letters, x) - 1) as v, length(c.b) as n, length(c.letters) as k)"),
        (
            "c",
            "struct(c.start, c.end, c.enc, c.n, xxhash64(c.b) as id, c.k,"
            " aggregate(sequence(1, c.k), 0D, (a, j) -> a + pow(c.n - length(replace(c.b, substr(c.letters, j, 1), '')), 2)) * c.k / c.n - c.n as chi,"
            " aggregate(zip_with(slice(c.v, 1, c.n - 1), slice(c.v, 2, c.n - 1), (x, y) -> if((2 * x >= c.k) <> (2 * y >= c.k), 1, 0)), 0, (a, x) -> a + x) as turns,"
            " aggregate(zip_with(slice(c.v, 1, c.n - 1), slice(c.v, 2, c.n - 1), (x, y) -> (x - (c.k - 1) / 2) * (y - (c.k - 1) / 2)), 0D, (a, x) -> a + x) as lag)",
        ),
        (
            "c",
            "struct(c.start, c.end, c.enc, c.n, c.id, (c.chi - (c.k - 1)) / sqrt(2D * (c.k - 1) * (c.n - 1) / c.n) as z_chi,"
            " abs(c.turns - (c.n - 1) / 2) / sqrt((c.n - 1) / 4D) as z_turns, abs(c.lag) / ((pow(c.k, 2) - 1) / 12) / sqrt(c.n - 1D) as z_lag)",
        ),
        ("c", f"struct(c.start, c.end, c.enc, c.n, c.id, -ln(greatest({_tail('c.z_chi')}, 1e-300)) - ln(greatest(2 * {_tail('c.z_turns')}, 1e-300)) - ln(greatest(2 * {_tail('c.z_lag')}, 1e-300)) as h)"),
        ("c", "struct(c.start, c.end, c.enc, c.n, c.id, least(1D, exp(-c.h) * (1 + c.h + c.h * c.h / 2)) as p)"),
    ]
    out = f"filter({cut}, c -> c.g rlike '[0-9]' and c.g rlike '[A-Za-z]')"
    for i, (var, body) in enumerate(steps):
        out = f"transform({out}, {var} -> {body})"
        if i == 0:
            out = f"filter({out}, c -> length(c.b) >= 20)"
        if i == 1:
            out = f"filter({out}, c -> c.enc is not null)"
    return out


def _bars(tested: DataFrame, fdr: float) -> dict[tuple[str, int], float]:
    """The bars of all classes. A string counts once, however often it occurs.

    One count per class and hundredth of p comes to the driver: some thousands at most.
    """
    counts: dict[tuple[str, int], list[int]] = {}
    cls, bin_ = _length_class(F.col("c.n")), F.least(F.floor(F.col("c.p") * 100), F.lit(99)).cast("int")
    distinct = tested.select(F.explode("candidates").alias("c")).select(F.col("c.enc").alias("enc"), cls.alias("cls"), F.col("c.id").alias("id"), bin_.alias("bin")).distinct()
    seen = distinct.groupBy("enc", "cls", "bin").count()
    for r in seen.collect():
        counts.setdefault((r.enc, r.cls), [0] * 100)[r.bin] += r["count"]
    return _bars_of(counts, fdr)


def _bars_of(counts: dict[tuple[str, int], list[int]], fdr: float) -> dict[tuple[str, int], float]:
    """The p above which candidates of a class count as random; a class without one flags none.

    The lower of the bar that the counts prove and the fixed one, which falls away where
    the texts above it exceed their share by more than two standard errors.
    """
    bars = {}
    for key, bins in counts.items():
        upper = sum(bins[50:])
        random = max(0.0, upper - math.sqrt(upper)) / 0.5
        for i in range(round(FLOOR * 100), 51):
            above = sum(bins[i:])
            if above and max(0.0, above - random * (1 - i / 100)) <= fdr * above + math.sqrt(above) * fdr:
                bars[key] = i / 100
                break
        bar, by_chance = _by_chance(*key)
        above = sum(bins[round(bar * 100) :])
        random = max(0.0, upper - by_chance * sum(bins)) / (0.5 - by_chance)
        if above - random * (1 - bar) <= fdr * above + 2 * math.sqrt(above):
            bars[key] = min(bar, bars.get(key, bar))
    return bars


def _by_chance(enc: str, cls: int) -> tuple[float, float]:
    known = BY_CHANCE.get({"HEX": "hex", "BASE36": "base36"}.get(enc, enc), [])
    return known[cls - FIRST_CLASS] if cls - FIRST_CLASS < len(known) else (FLOOR, 0.0)


def _length_class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) * 2).cast("int")


def scan_secrets(docs: DataFrame, fdr: float = FDR, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` -> its columns ``keep`` (all by default) and base, spans: arrays of
    (start, rank, end, kind), ordered by start then kind.

    ``base`` are the matches of the three patterns, ``spans`` also the flagged
    candidates (kind ``random``) that overlap none of them. Null or empty text: empty
    arrays. A column of ``docs`` named base or spans is replaced. Repeated rows are
    scanned each; an empty table gives no rows.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("base", "spans", "candidates")]
    t = "harrow_text"
    base = f"concat({_kind(t, 0, 'assign', ASSIGN, MIN_ASSIGN, 2)}, {_kind(t, 1, 'access', ACCESS, MIN_ACCESS)}, {_kind(t, 2, 'hex', HEX_LONG, MIN_HEX)})"
    tested = docs.withColumn(t, F.coalesce(F.col(text), F.lit(""))).select(*keep, F.expr(f"array_sort(cast({base} as {_SPAN}))").alias("base"), F.expr(_battery(_cut(t, CANDIDATE))).alias("candidates"))
    tested = staged(tested, "secret-candidates")
    bars = _bars(tested, fdr)
    rule = " or ".join(f"(c.enc = '{enc}' and cast(floor(log2(cast(c.n as double)) * 2) as int) = {cls} and c.p >= {bar}D)" for (enc, cls), bar in sorted(bars.items())) or "false"
    extra = F.expr(f"transform(filter(candidates, c -> ({rule}) and not exists(base, b -> b.start < c.end and c.start < b.end)), c -> struct(c.start as start, 3 as rank, c.end as end, 'random' as kind))")
    return tested.withColumn("spans", F.array_sort(F.concat("base", extra.cast(_SPAN)))).select(*keep, "base", "spans")


def _listed(column: str) -> Column:
    return F.expr(f"array_join(transform({column}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def redact(scanned: DataFrame, text: str = "text", placeholder: str = PLACEHOLDER) -> DataFrame:
    """Replace every span (overlapping ones together) by the placeholder; drops base and spans.

    Null text stays null. Stretches of ``STRIDE`` spans are cut out of the text first,
    so a text with very many spans is not walked from its start for each.
    """
    reach = running("spans", "e.end", MAXIMUM)
    # What lies between the farthest end so far and a span's start is kept; a span that begins earlier belongs to the one before.
    kept = f"filter(zip_with(spans, {reach}, (x, at) -> struct(at as at, x.start as start)), x -> x.start >= x.at)"
    base, last = "element_at(some, 1).at", "element_at(some, -1).start"
    own = f"transform(array(substring({text}, cast({base} + 1 as int), cast({last} - {base} as int))), t -> array_join(transform(some, x -> concat(substring(t, cast(x.at - {base} + 1 as int), cast(x.start - x.at as int)), {_sql(placeholder)})), ''))"
    strides = f"transform(sequence(0, (size(k) - 1) div {STRIDE}), i -> slice(k, i * {STRIDE} + 1, {STRIDE}))"
    front = f"element_at(transform(array({kept}), k -> array_join(transform({strides}, some -> element_at({own}, 1)), '')), 1)"
    end = "cast(array_max(transform(spans, x -> x.end)) + 1 as int)"
    return scanned.withColumn(text, F.expr(f"if(size(spans) > 0, concat({front}, substring({text}, {end})), {text})")).drop("base", "spans")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all of ``documents``, by ``scan_secrets``."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    count = lambda kind: F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
