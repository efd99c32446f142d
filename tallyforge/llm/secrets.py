"""Secret scans with DataFrame functions only.

Three base kinds are regular expressions.  Their code point offsets follow from
the pieces between matches: splitting at a pattern and extracting it walk over
the same leftmost matches, so lengths of pieces and matches add up to places.

Further secrets are found by Shannon entropy: a window of `WINDOW` characters
slides over each candidate string.  The counts of its characters are carried
along, twelve to a number; a step takes one character out and one in, and
updates the entropy from these two counts alone.  Each character class of
candidates has its own threshold.  Windows that touch an allow-listed stretch
or a base span are suppressed: the candidate is cut there and the pieces of a
window or more are scanned.  A piece of plain words is suppressed as a whole.

Everything is one projection: no shuffle, no state, no Python on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm._frames import table

KINDS = ("assign", "access", "hex", "entropy")
KEYWORDS = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = r"""(KEYWORDS)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("KEYWORDS", KEYWORDS)
#: A run of too few characters holds no longer match, so asking for the length
#: in the pattern gives the matches that dropping short ones afterwards gives.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least entropy of a window in bits: hexadecimal, three character classes, two, one.
THRESHOLDS = {"hex": 3.0, "three": 3.6, "two": 3.8, "one": 4.1}
#: Stretches that aren't secrets: placeholders and, besides these, RUN or more of one character.  No capturing groups.
ALLOW = r"(?i:example|sample|placeholder|dummy|lorem|changeme|0123456789)"
RUN = 8
#: Pieces that aren't secrets: paths and dashed or underscored words.
WORDS = r"(?i)^[a-z]+([-_/=+][a-z]+)*[-_/=+]*$|^[-_=+/]+$"
#: Counts of WINDOW at most in a number, their bits, and the first of the characters of a candidate.
PACKED, BITS, LOWEST, LETTERS = 12, 5, ord("+"), ord("z") - ord("+") + 1
MASK = "[SECRET]"

SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
VALUED = "array<struct<start:bigint,kind:int,end:bigint,v:string>>"


#: Spans that are gathered before they join the others, so that a text of many isn't copied with each.
BLOCK = 256


def _placed(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0, value: bool = False) -> Column:
    """Spans of a pattern, with what they cover if `value`; those whose group is shorter than `least` are dropped."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"))
    kind_of = VALUED if value else SPAN
    empty, blocks = F.expr(f"cast(array() as {kind_of})"), F.expr(f"cast(array() as array<{kind_of}>)")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("found"), blocks.alias("full"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["p"])
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), *([x["m"].alias("v")] if value else []))
        fits, filled = F.length(x["g"]) >= least, F.size(acc["found"]) >= BLOCK
        found = F.when(~F.coalesce(fits, F.lit(False)), acc["found"]).when(filled, F.array(span)).otherwise(F.concat(acc["found"], F.array(span)))
        full = F.when(fits & filled, F.concat(acc["full"], F.array(acc["found"]))).otherwise(acc["full"])
        return F.struct(end.alias("at"), found.alias("found"), full.alias("full"))

    spans = F.aggregate(zipped, start, step, lambda acc: F.flatten(F.concat(acc["full"], F.array(acc["found"]))))
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def _pieces(candidates: Column, allow: str) -> Column:
    """The candidates without their allow-listed stretches."""
    letter = "[A-Za-z0-9+/_=-]"
    stop = rf"{allow}|({letter})\1{{{RUN - 1},}}"
    pattern = rf"{stop}|((?:(?!{allow}|({letter})\3{{{RUN - 1}}}){letter}){{{WINDOW},}}+)"

    def cut(c):
        inside = F.transform(_placed(c["v"], pattern, 3, group=2, least=WINDOW, value=True), lambda p: F.struct((p["start"] + c["start"]).alias("start"), p["kind"].alias("kind"), (p["end"] + c["start"]).alias("end"), p["v"].alias("v")))
        return F.when(c["v"].rlike(stop), inside).otherwise(F.array(c))

    return F.flatten(F.transform(candidates, cut))


def _windows(value: str) -> str:
    """SQL: struct(a, b) of a candidate, the bounds of its windows of high entropy, -1 without one."""
    w, t = WINDOW, THRESHOLDS
    xlogx = [k * math.log2(k) if k else 0.0 for k in range(w + 2)]
    gain = "array(" + ", ".join(f"{b - a!r}D" for a, b in zip(xlogx, xlogx[1:])) + ")"
    classes = f"(cast({value} rlike '[a-z]' as int) + cast({value} rlike '[A-Z]' as int) + cast({value} rlike '[0-9]' as int))"
    least = f"(case when {value} rlike '^(?:[0-9a-f]+|[0-9A-F]+)$' and {classes} = 2 then {t['hex']}D when {classes} = 3 then {t['three']}D when {classes} = 2 then {t['two']}D else {t['one']}D end)"
    places = f"transform(split({value}, ''), x -> named_struct('w', cast((ascii(x) - {LOWEST}) div {PACKED} as int), 's', {BITS} * ((ascii(x) - {LOWEST}) % {PACKED})))"
    # the character that comes, the one that goes (null before the first goes), and their counts
    here, gone = "z.q[i]", f"get(z.q, i - {w})"
    counted = lambda x: f"cast(shiftright(acc.n[{x}.w], {x}.s) & {(1 << BITS) - 1}L as int)"
    n = f"({counted(here)} - if({here} = {gone}, 1, 0))"
    h = f"(acc.h + {gain}[{n}] - if(i >= {w}, {gain}[{counted(gone)} - 1], 0D))"
    counts = f"transform(acc.n, (k, j) -> k + if(j = {here}.w, shiftleft(1L, {here}.s), 0L) - if(j = {gone}.w, shiftleft(1L, {gone}.s), 0L))"
    high = f"i >= {w - 1} and {math.log2(w)!r}D - h / {w} >= z.t"
    return (
        f"transform(array(named_struct('q', {places}, 't', {least})), z -> aggregate(sequence(0, size(z.q) - 1), "
        f"named_struct('h', 0D, 'a', -1, 'b', -1, 'n', array_repeat(0L, {-(-LETTERS // PACKED)})), (acc, i) -> transform(array({h}), h -> named_struct("
        f"'h', h, 'a', if(acc.a < 0 and {high}, i - {w - 1}, acc.a), 'b', if({high}, i + 1, acc.b), 'n', {counts}))[0], "
        f"acc -> named_struct('a', acc.a, 'b', acc.b)))[0]"
    )


def _entropy(pieces: str, base: str) -> Column:
    """Spans of high entropy in what the spans of `base` leave of the pieces."""
    words = "'" + WORDS.replace("\\", "\\\\").replace("'", "\\'") + "'"
    # between the base spans that meet a piece; these may lie in each other
    gaps = (
        "transform(sequence(0, size(o)), k -> transform(array(if(k = 0, c.start, greatest(c.start, array_max(transform(slice(o, 1, k), x -> x.end))))), "
        "s -> named_struct('start', s, 'v', substring(c.v, cast(s - c.start as int) + 1, cast(greatest(if(k = size(o), c.end, get(o, k).start) - s, 0L) as int))))[0])"
    )
    left = (
        f"flatten(transform({pieces}, c -> transform(array(filter({base}, b -> b.start < c.end and c.start < b.end)), "
        f"o -> if(size(o) = 0, array(named_struct('start', c.start, 'v', c.v)), filter({gaps}, g -> length(g.v) >= {WINDOW})))[0]))"
    )
    spans = f"transform(filter({left}, c -> not c.v rlike {words}), c -> named_struct('s', c.start, 'w', {_windows('c.v')}))"
    return F.expr(f"transform(filter({spans}, c -> c.w.a >= 0), c -> named_struct('start', c.s + c.w.a, 'kind', 3, 'end', c.s + c.w.b))")


def scan(documents: DataFrame, text: str = "text", allow: str = ALLOW) -> DataFrame:
    """All columns of `documents` plus base_spans and secret_spans: arrays of
    (start, kind, end), sorted; kind counts from 0 in the order of KINDS,
    offsets are code points, end exclusive.  secret_spans has the entropy
    method's spans too.

    Null counts as the empty text, which has no spans.  Texts are scanned
    whole; repeated rows alike.  Input columns with a result's name are
    replaced.
    """
    names = [c for c in documents.columns if c.lower() not in ("base_spans", "secret_spans")]
    # own columns go under numbers, so that none can be taken for one made here
    held = {c: f"__k{i}" for i, c in enumerate(names)}
    inner = documents.select(*[F.col(f"`{c}`").alias(k) for c, k in held.items()], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    column = F.col("__text")
    assign = F.when(column.rlike(KEYWORDS), _placed(column, ASSIGN, 0, group=2, least=8)).otherwise(F.expr(f"cast(array() as {SPAN})"))
    with_base = inner.withColumn("base_spans", F.array_sort(F.concat(assign, _placed(column, ACCESS, 1), _placed(column, HEX, 2))))
    with_pieces = with_base.withColumn("__cand", _placed(column, CANDIDATE, 3, value=True)).withColumn("__piece", _pieces(F.col("__cand"), allow))
    out = with_pieces.withColumn("secret_spans", F.array_sort(F.concat("base_spans", _entropy("__piece", "base_spans").cast(SPAN))))
    return out.select(*[F.col(k).alias(c) for c, k in held.items()], "base_spans", "secret_spans")


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat({kinds}[s.kind], ':', s.start, ':', s.end)), ',')")


def redact(documents: DataFrame, text: str = "text", mask: str = MASK, allow: str = ALLOW) -> DataFrame:
    """`documents` with each stretch of secret characters of `text` replaced by
    `mask`, and n_chars, if there is such a column, brought up to date.  Rows
    without secrets, null texts among them, stay as they are."""
    names = documents.columns
    held = documents.select(*[F.col(f"`{c}`").alias(f"__own{i}") for i, c in enumerate(names)], F.col(f"`{text}`").alias("text"))
    found = scan(held, "text", allow)
    new = F.expr(
        "case when size(secret_spans) = 0 then text else aggregate(secret_spans, named_struct('at', cast(0 as bigint), 'out', ''), (acc, s) -> named_struct("
        f"'at', greatest(acc.at, s.end), 'out', concat(acc.out, substring(text, cast(acc.at as int) + 1, cast(greatest(s.start - acc.at, 0L) as int)), if(s.start >= acc.at, '{mask}', ''))), "
        "acc -> concat(acc.out, substring(text, cast(acc.at as int) + 1))) end"
    )
    out = found.withColumn("__new", new)
    changed = F.size("secret_spans") > 0
    columns = []
    for i, f in enumerate(documents.schema.fields):
        own = F.col(f"__own{i}")
        if f.name == text:
            own = F.col("__new")
        elif f.name == "n_chars":
            own = F.when(changed, F.length("__new").cast(f.dataType)).otherwise(own)
        columns.append(own.alias(f.name))
    return out.select(*columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = {k: F.expr(f"cast(size(filter(base_spans, s -> s.kind = {i})) as bigint)") for i, k in enumerate(KINDS[:3])}
    return found.select(
        "doc_id", *[count[k].alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("secret_spans").alias("spans"),
    )


def brute(text: str | None, allow: str = ALLOW) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans in plain Python, for tests."""
    import re
    from collections import Counter

    t, out = text or "", []
    for m in re.finditer(ASSIGN, t):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    blocked = set()
    for m in re.finditer(rf"{allow}|([A-Za-z0-9+/_=-])\1{{{RUN - 1},}}", t):
        blocked.update(range(*m.span()))
    for s, _, e in out:
        blocked.update(range(s, e))
    free = "".join(" " if i in blocked else c for i, c in enumerate(t))
    for m in re.finditer(CANDIDATE, free):
        v = m[0]
        if re.search(WORDS, v):
            continue
        classes = sum(bool(re.search(c, v)) for c in ("[a-z]", "[A-Z]", "[0-9]"))
        hexed = classes == 2 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", v)
        least = THRESHOLDS["hex" if hexed else "three" if classes == 3 else "two" if classes == 2 else "one"]
        high = []
        for i in range(len(v) - WINDOW + 1):
            n = Counter(v[i : i + WINDOW])
            if math.log2(WINDOW) - sum(c * math.log2(c) for c in n.values()) / WINDOW >= least - 1e-12:
                high.append(i)
        if high:
            out.append((m.start() + high[0], 3, m.start() + high[-1] + WINDOW))
    return sorted(out)
