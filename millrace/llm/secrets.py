"""Secret scans: patterns and a battery of randomness tests, with SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh

#: Kinds in the order in which they are listed.  A match is dropped if its token is shorter than the least length.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs of 24 and more are the same as all runs without the shorter ones
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Encodings in the order in which they are tried: pattern and alphabet in order of value.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("^[A-Z2-7]+$", UPPER + DIGITS[2:8]),
    ("^[0-9a-z]+$", DIGITS + LOWER),
    ("^[0-9A-Z]+$", DIGITS + UPPER),
    ("^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
)

#: Natural text: chances of the class of the next sign (lower, upper, digit, other) at a token's start and after each class.
SIGNS = UPPER + LOWER + DIGITS + "+/-_"
CLASSES = {"": (0.55, 0.25, 0.10, 0.10), "a": (0.80, 0.05, 0.05, 0.10), "A": (0.27, 0.55, 0.06, 0.12), "0": (0.05, 0.05, 0.82, 0.08), "+": (0.62, 0.20, 0.13, 0.05)}
#: Words of names, paths and prose in four languages, from whose letters the chances of letters after letters are counted.
NATURAL = (
    "the and that have for not with you this but from they will would there their what about which when make can like time just know take people into year good some could them see other than then now look only come over think also back after use two how our work first well way even new want because any these give day most",
    "index table value return default option version release build config status network address buffer handle parser request response session object string number array module package import export public private static class function method library system user local share site file folder path page image style script test debug error message level service client server query cache queue event update delete select order group",
    "les des une dans pour que qui est pas sur avec plus sont comme mais nous vous leur cette entre ainsi toujours",
    "der die und den von das mit sich des auf nicht ein eine als auch werden aus hat dass durch zwischen schon",
    "los las del por una con para como pero sus este entre cuando todo esta desde nosotros porque ciudad mejor",
)
#: How many times all letters count as followers of each letter, in proportion to their own counts, and the share of chances that is even.
PRIOR, EVEN = 3.0, 0.2


def _followers() -> list[list[float]]:
    """The chance of each letter after each letter, then at the start of a word."""
    counts = [[0.0] * 26 for _ in range(27)]
    for word in " ".join(NATURAL).split():
        for last, letter in zip((26, *map(LOWER.index, word)), word, strict=False):
            counts[last][LOWER.index(letter)] += 1
    own = [sum(row[k] for row in counts) for k in range(26)]
    share = [n / sum(own) for n in own]
    return [[(1 - EVEN) * (n + PRIOR * s) / (sum(row) + PRIOR) + EVEN / 26 for n, s in zip(row, share, strict=True)] for row in counts]


def _costs() -> list[float]:
    """-ln of the chance of every sign after nothing and after every sign in natural text, in rows of SIGNS."""
    kind = lambda s: "a" if s in LOWER else "A" if s in UPPER else "0" if s in DIGITS else "+"
    rows = _followers()
    costs = []
    for last in ("", *SIGNS):
        row = rows[LOWER.index(last.lower()) if last.isalpha() else 26]
        for s in SIGNS:
            among = row[LOWER.index(s.lower())] / sum(row) if s.isalpha() else 1 / sum(kind(s) == kind(t) for t in SIGNS)
            costs.append(-math.log(CLASSES[last and kind(last)]["aA0+".index(kind(s))] * among))
    return costs


#: Grids of evidence (-ln p) that a token is random, and that it isn't.
STEP, STEPS = 0.25, 400
DOUBT_STEP, DOUBT_STEPS = 0.5, 40


def _bound(value: str, name: str, body: str) -> str:
    """SQL for body with name standing for value, which is computed once however often the body needs it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _scan(numbers: str, step: str) -> str:
    """SQL for running results over an array by doubling distances: v stands for an entry, w for one before it.

    An array that grew entry by entry would be copied as often.
    """
    distances = "transform(sequence(0, CAST(ceil(log2(size(zs.x) + 1)) AS INT)), e -> CAST(power(2, e) AS INT))"
    merged = step.replace("w", "za[i - zk]")
    return _bound(f"named_struct('x', {numbers})", "zs", f"aggregate({distances}, zs.x, (za, zk) -> CASE WHEN zk < size(za) THEN transform(za, (v, i) -> CASE WHEN i >= zk THEN {merged} ELSE v END) ELSE za END)")


def _found(pattern: str, group: int = 0) -> str:
    """SQL for all matches in t, in order: array of (start, end, x), x the group's text.

    split() and regexp_extract_all() walk the same matches, so running sums of
    the lengths of what lies between them and of themselves give every place.
    """
    parts = f"named_struct('g', split(t, r'{pattern}', -1), 'm', regexp_extract_all(t, r'{pattern}', 0), 'x', regexp_extract_all(t, r'{pattern}', {group}))"
    ends = _scan("transform(p.m, (m, i) -> length(m) + length(p.g[i]))", "v + w")
    places = f"transform({ends}, (q, i) -> named_struct('start', q - length(p.m[i]), 'end', q, 'x', p.x[i]))"
    return f"CASE WHEN t RLIKE r'{pattern}' THEN {_bound(parts, 'p', places)} ELSE CAST(array() AS array<struct<start:int,`end`:int,x:string>>) END"


def _spans(order: int, kind: str, found: str) -> str:
    return f"transform({found}, m -> named_struct('start', m.start, 'order', {order}, 'end', m.`end`, 'kind', '{kind}'))"


def _pick(column: str, index: int) -> str:
    """SQL that picks an entry of ENCODINGS by the number e."""
    return f"element_at(array({', '.join(repr(x[index]) for x in ENCODINGS)}), {column})"


def _tested() -> str:
    """SQL for the tokens that may be random: array of (start, end, n, evidence, doubt).

    The encoding is the first whose symbols cover the token; tokens without a
    digit or without a letter are words or numbers and are not tested.
    Evidence is the log-likelihood ratio of random symbols of the encoding to
    natural text, less ln of the number of encodings: natural text reaches
    evidence x with a chance of at most exp(-x) (Markov's inequality).
    Doubt is what the battery says against randomness: the largest of the
    three tests' bounds of -ln p (z * z / 2, the chi-squared value taken to a
    normal one by its cube root), less ln 3, since there are three.
    """
    first = " ".join(f"WHEN m.x RLIKE '{p}' THEN {k}" for k, (p, _) in enumerate(ENCODINGS, 1))
    tokens = f"filter({_found(TOKEN)}, m -> m.x RLIKE '[0-9]' AND m.x RLIKE '[A-Za-z]')"
    coded = f"filter(transform({tokens}, m -> named_struct('m', m, 'e', CASE {first} END)), c -> c.e IS NOT NULL)"
    # sums over symbols and over neighbours
    alphabet = _pick("c.e", 1)
    costs = f"CAST(split('{','.join(f'{c:.4f}' for c in _costs())}', ',') AS array<double>)"
    counted = f"""transform({coded}, c -> named_struct(
        'm', c.m, 'n', length(c.m.x), 'size', length({alphabet}),
        'squares', aggregate(sequence(1, length({alphabet})), 0D, (a, k) -> a + power(length(c.m.x) - length(replace(c.m.x, substr({alphabet}, k, 1), '')), 2)),
        'natural', aggregate(transform(filter(split(c.m.x, ''), s -> s <> ''), s -> instr('{SIGNS}', s)), named_struct('last', 0, 'sum', 0D),
            (a, v) -> named_struct('last', v, 'sum', a.sum + element_at({costs}, a.last * {len(SIGNS)} + v)), a -> a.sum),
        'halves', transform(filter(split(c.m.x, ''), s -> s <> ''), s -> instr({alphabet}, s) - 1)))"""
    halved = f"""transform({counted}, c -> named_struct('m', c.m, 'n', c.n, 'size', c.size, 'squares', c.squares, 'natural', c.natural,
        'low', size(filter(c.halves, v -> 2 * v < c.size)),
        'walk', aggregate(c.halves, named_struct('last', -1, 'runs', 0, 'sum', 0D, 'square', 0D, 'cross', 0D), (a, v) -> named_struct(
            'last', v, 'runs', a.runs + CASE WHEN a.last < 0 OR (2 * v < c.size) <> (2 * a.last < c.size) THEN 1 ELSE 0 END,
            'sum', a.sum + v, 'square', a.square + CAST(v AS DOUBLE) * v, 'cross', a.cross + CASE WHEN a.last < 0 THEN 0D ELSE CAST(v AS DOUBLE) * a.last END))))"""
    scored = f"""transform({halved}, c -> named_struct('start', c.m.start, 'end', c.m.`end`, 'n', c.n,
        'chi', c.size / CAST(c.n AS DOUBLE) * c.squares - c.n, 'df', c.size - 1,
        'gain', c.natural - c.n * ln(CAST(c.size AS DOUBLE)),
        'runs', CASE WHEN c.low IN (0, c.n) THEN 99D ELSE abs(c.walk.runs - 1 - 2D * c.low * (c.n - c.low) / c.n)
            / sqrt(greatest(2D * c.low * (c.n - c.low) * (2D * c.low * (c.n - c.low) - c.n) / (CAST(c.n AS DOUBLE) * c.n * (c.n - 1)), 0.01D)) END,
        'serial', CASE WHEN c.walk.square * c.n <= c.walk.sum * c.walk.sum THEN 99D ELSE sqrt(CAST(c.n AS DOUBLE))
            * abs((c.walk.cross / (c.n - 1) - c.walk.sum * c.walk.sum / (CAST(c.n AS DOUBLE) * c.n)) / (c.walk.square / c.n - c.walk.sum * c.walk.sum / (CAST(c.n AS DOUBLE) * c.n))) END))"""
    chi = "(cbrt(greatest(c.chi, 0D) / c.df) - 1 + 2D / (9 * c.df)) / sqrt(2D / (9 * c.df))"
    doubt = f"power(greatest({chi}, c.runs, c.serial, 0D), 2) / 2 - ln(3D)"
    return f"transform({scored}, c -> named_struct('start', c.start, 'end', c.`end`, 'n', c.n, 'evidence', c.gain - ln({len(ENCODINGS)}D), 'doubt', {doubt}))"


def _base(docs: DataFrame) -> DataFrame:
    """All columns of docs, numbered, with base (spans of the three patterns) and t, the text."""
    names = docs.columns
    body = docs.select(*(F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(names)), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    kinds = [
        _spans(1, "assign", f"filter({_found(ASSIGN, 1)}, m -> length(m.x) >= {LEAST['assign']})"),
        _spans(2, "access", f"filter({_found(ACCESS)}, m -> length(m.x) >= {LEAST['access']})"),
        _spans(3, "hex", _found(HEX)),
    ]
    return body.withColumn("base", F.expr(f"array_sort(concat({', '.join(kinds)}))")).withColumn("tokens", F.expr(_tested()))


def _octave(n: Column) -> Column:
    return F.log2(n.cast("double")).cast("int")


def _step_up(counts: dict[float, int], total: int, rate: float) -> float:
    """The least -ln p of those in counts at which, by the rule of Benjamini and Hochberg, expected false finds among ``total`` tests stay below ``rate``."""
    best, seen = math.inf, 0
    for evidence in sorted(counts, reverse=True):
        seen += counts[evidence]
        if total * math.exp(-evidence) <= rate * seen:
            best = evidence
    return best


def false_discovery_limits(docs: DataFrame, rate: float = 0.01) -> tuple[float, float, float]:
    """The least weighted evidence that counts as random, the weighted doubt from which it doesn't, and the mean weight.

    Every token that the battery tests is a hypothesis "natural text", which
    evidence may refute; of those for which it does, each is a hypothesis
    "random", which the battery's doubt may refute.  Both families are held
    to ``rate`` false finds by the step-up rule, with p-values divided by
    weights of mean 1 that grow with a token's length (by octave), since long
    tokens tell more.  Evidence and doubt are rounded down to a grid, as they
    are when the limits are applied, so the rate holds as stated.  The tokens
    of all documents take part; counts by grid step and octave are all that
    leaves the executors.
    """
    tokens = _base(docs).select(F.explode("tokens").alias("k")).select("k.n", "k.evidence", "k.doubt")
    gain = F.least(F.floor(F.greatest(F.col("evidence"), F.lit(-STEP)) / STEP), F.lit(STEPS)).alias("gain")
    doubt = F.when(F.col("evidence") >= 0, F.least(F.floor(F.greatest(F.col("doubt"), F.lit(-DOUBT_STEP)) / DOUBT_STEP), F.lit(DOUBT_STEPS))).otherwise(-1).alias("doubt")
    table = tokens.groupBy(gain, doubt, _octave(F.col("n")).alias("octave")).agg(F.count("*").alias("tokens")).collect()  # at most STEPS * DOUBT_STEPS * 31 rows, of which few occur
    total = sum(r["tokens"] for r in table)
    if not total:
        return math.inf, math.inf, 1.0
    mean = sum(r["tokens"] * 2.0 ** r["octave"] for r in table) / total

    def counts(rows, key: str, step: float) -> dict[float, int]:
        out: dict[float, int] = {}
        for r in rows:
            evidence = r[key] * step + math.log(2.0 ** r["octave"] / mean)
            out[evidence] = out.get(evidence, 0) + (r["tokens"] if r[key] >= 0 else 0)
        return out

    random = _step_up(counts(table, "gain", STEP), total, rate)
    passed = [r for r in table if r["gain"] >= 0 and r["gain"] * STEP + math.log(2.0 ** r["octave"] / mean) >= random - 1e-9]
    return random, _step_up(counts(passed, "doubt", DOUBT_STEP), sum(r["tokens"] for r in passed), rate), mean


def _without_overlaps(spans: str) -> str:
    """SQL for sorted spans without the random ones that overlap a pattern's span."""
    until = _scan("transform(a, s -> CASE WHEN s.order < 4 THEN s.`end` ELSE 0 END)", "greatest(v, w)")
    since = f"reverse({_scan('transform(reverse(a), s -> CASE WHEN s.order < 4 THEN s.start ELSE 2147483647 END)', 'least(v, w)')})"
    return _bound(spans, "a", _bound(f"named_struct('until', {until}, 'since', {since})", "b", "filter(a, (s, i) -> s.order < 4 OR b.until[i] <= s.start AND b.since[i] >= s.`end`)"))


def scan(docs: DataFrame, rate: float = 0.01, spans_column: str = "spans") -> DataFrame:
    """The documents, with all their columns, and spans: (start, order, end, kind), by start, then kind as listed.

    A column of docs with the name of the last is replaced.

    start and end are code points, end exclusive.  Kinds are assign, access
    and hex, found by pattern, leftmost and non-overlapping for each kind,
    and random: tokens of 20 or more signs of an encoding whose likelihood
    ratio against natural text passes the corpus-wide false-discovery limit,
    unless a chi-squared test of uniformity, a runs test and a
    serial-correlation test refute under the like limit that its symbols are
    random.  A random token that overlaps a pattern's span is not listed
    again.

    Tokens without a digit or without a letter are not tested, so that keys of
    letters only or of digits only are never random.

    A null or empty text has no spans; repeated rows stay, each with its
    spans; the time for a text of any length is in proportion to it, but for
    sorting its spans; an empty table gives an empty result.
    """
    limit, doubted, mean = false_discovery_limits(docs, rate)
    docs = docs.select(*(F.col(f"`{n}`") for n in docs.columns if n != spans_column))
    names = docs.columns
    if limit < math.inf:
        weight = f"ln(power(2D, CAST(log2(CAST(k.n AS DOUBLE)) AS INT)) / {mean!r}D)"
        grid = lambda value, step: f"floor({value} / {step}D) * {step}D + {weight}"
        passes = f"k.evidence >= 0 AND {grid(f'least(k.evidence, {STEP * STEPS}D)', STEP)} >= {limit - 1e-9!r}D"
        if doubted < math.inf:
            passes += f" AND {grid(f'least(greatest(k.doubt, {-DOUBT_STEP}D), {DOUBT_STEP * DOUBT_STEPS}D)', DOUBT_STEP)} < {doubted - 1e-9!r}D"
        random = f"transform(filter(tokens, k -> {passes}), k -> named_struct('start', k.start, 'order', 4, 'end', k.`end`, 'kind', 'random'))"
        both = _bound(f"named_struct('r', {random}, 'base', base)", "f", f"CASE WHEN size(f.r) = 0 THEN f.base ELSE {_without_overlaps('array_sort(concat(f.base, f.r))')} END")
    else:
        both = "base"
    found = _base(docs).withColumn("spans", F.expr(both))
    return found.select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(names)), F.col("spans").alias(spans_column))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", rate: float = 0.01) -> DataFrame:
    """The documents, with all their columns, with every stretch of overlapping spans in text replaced by ``mark``.

    Nulls, repeated rows, long texts and empty tables are as with scan(); a
    text without spans, null or empty, stays as it is.  Places are found in
    the text as UTF-32, where each sign has four bytes, so a text of many
    spans is walked once.
    """
    spans = fresh("spans", docs.columns)
    found = scan(docs, rate, spans)
    until = _scan("transform(a, s -> s.`end`)", "greatest(v, w)")
    # a stretch begins where no span before it reaches beyond the start
    begins = "filter(sequence(0, size(a) - 1), i -> i = 0 OR a[i].start >= b.until[i - 1])"
    start = "CASE WHEN k < size(d.at) THEN a[d.at[k]].start ELSE length(d.t) END"
    end = "CASE WHEN k = 0 THEN 0 ELSE b.until[CASE WHEN k < size(d.at) THEN d.at[k] ELSE size(a) END - 1] END"
    piece = f"decode(substring(d.wide, 4 * ({end}) + 1, 4 * (({start}) - ({end}))), 'UTF-32')"
    pieces = f"array_join(transform(sequence(0, size(d.at)), k -> {piece}), '{mark.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}')"
    made = _bound(f"`{spans}`", "a", _bound(f"named_struct('until', {until})", "b", _bound(f"named_struct('at', {begins}, 't', CAST(text AS STRING), 'wide', encode(CAST(text AS STRING), 'UTF-32'))", "d", pieces)))
    return found.withColumn("text", F.expr(f"CASE WHEN size(`{spans}`) > 0 THEN {made} ELSE text END")).drop(spans)
