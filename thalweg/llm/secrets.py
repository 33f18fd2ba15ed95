"""Secret scans with DataFrame functions only.

Three patterns give the base spans. Beside them, runs of token characters are candidates: for each
character class a window slides over the run, and its Shannon entropy follows from counts that change by
one character in and one out. Windows above the class's threshold merge into spans of kind `entropy`. The
allow list suppresses a candidate that has a harmless shape as a whole (a UUID, a path), and windows that
hold, or lie within NEAR characters of, a word such as "example" or a character repeated eight times; the rest
of a long candidate stays. Base spans always stay.

Folds that gather values run over blocks of BLOCK elements, and arrays that they look into are bound once,
so the cost of a text is linear in its length and in its number of matches.

Defined results: a null text is empty and has no spans; repeated rows and null ids are scanned row by row;
two spans that start together come in the order of KINDS; columns other than doc_id and text are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
#: The patterns, and the fewest characters of the group named.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
HEX_16 = r"[0-9a-f]{16,}"

#: Candidates for the entropy windows: runs of token characters, at least a window long.
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: A candidate needs all of these; words and rulers do not have them.
NEEDS = ("[0-9]", "[A-Za-z]")
#: Shapes of whole candidates that are known not to be secrets. A path has words, single separators and up to four digits at its end.
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
PATH, SEPARATOR, SEPARATORS = r"^[A-Za-z][A-Za-z/_-]*[A-Za-z][0-9]{0,4}$", r"[/_-]", r"[/_-]{2}"
#: What suppresses the windows around it.
ALLOWED, NEAR = r"(?i)example|sample|dummy|placeholder|changeme|(?<![a-z])test(?![a-z])|(.)\1{7}", 8
BLOCK = 256


def _bind(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(n: Column) -> Column:
    """0, 1, ... for each block of n elements."""
    return F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))


def _before(steps: Column) -> Column:
    """For each element of an array the sum of those before it: by block, and over the blocks' sums."""
    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

    def by_block(all_: Column) -> Column:
        return F.transform(_blocks(F.size(all_)), lambda k: F.aggregate(F.slice(all_, k * BLOCK + 1, F.lit(BLOCK)), none, step))

    def shifted(blocks: Column) -> Column:
        starts = F.aggregate(F.transform(blocks, lambda b: b["at"]), none, step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, starts, lambda b, start: F.transform(b["out"], lambda x: x + start)))

    return _bind(steps, lambda all_: _bind(by_block(all_), shifted))


def _located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places, from the pieces between them."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,text:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), found, lambda piece, own: F.struct(F.length(piece).cast("bigint").alias("gap"), F.length(own).cast("bigint").alias("long"), own.alias("text")))

    def placed(ps: Column) -> Column:
        starts = _before(F.transform(ps, lambda p: p["gap"] + p["long"]))
        return F.zip_with(ps, starts, lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["long"]).alias("end"), p["text"].alias("text")))

    return F.when(text.rlike(pattern), _bind(F.filter(pairs, lambda p: p["text"].isNotNull()), placed)).otherwise(none)


def _spans(found: str, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))


#: Thresholds of the entropy in bits for the two character classes: windows of hexadecimal digits alone, and any.
HEX_BITS, ANY_BITS = 2.9, 3.7
HEX_DIGIT = "^[0-9a-fA-F]$"
#: What c * log2(c) grows by from c to c + 1.
GROWTH = tuple((c + 1) * log2(c + 1) - (c * log2(c) if c else 0.0) for c in range(WINDOW + 1))


def _window_starts(chars: Column) -> Column:
    """Where windows start that reach the threshold of each class: an array for hexadecimal windows and one for any.

    A window and the next share all but one character of each. How often the character that comes in, and the one
    that goes out, occurs among the shared ones gives what the sum of c * log2(c) over all characters changes by;
    entropy is log2(WINDOW) - sum / WINDOW. A block's fold begins a window before it; blocks with too few different
    characters for either threshold are passed over.
    """
    least = ceil(2 ** min(HEX_BITS, ANY_BITS))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("run"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("hex"), F.array().cast("array<int>").alias("any"))

    def grows(shared: Column, one: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, GROWTH)), F.length(shared) - F.length(F.replace(shared, one, F.lit(""))) + 1)

    def of(block: Column) -> Column:
        ahead = F.least(block * BLOCK, F.lit(WINDOW - 1))

        def changes(part: Column) -> Column:
            """For each character of a block what the sum changes by, and whether it is a hexadecimal digit."""

            def change(one: Column, i: Column) -> Column:
                shared = F.substring(part, F.greatest(i - WINDOW + 2, F.lit(1)), F.least(i, F.lit(WINDOW - 1)))
                out = F.substring(part, F.greatest(i - WINDOW + 1, F.lit(1)), F.lit(1))
                gone = F.when(i >= WINDOW, grows(shared, out)).otherwise(0.0)
                return F.struct((grows(shared, one) - gone).alias("by"), one.rlike(HEX_DIGIT).alias("hex"))

            return F.transform(F.slice(chars, block * BLOCK - ahead + 1, ahead + BLOCK), change)

        def step(acc: Column, x: Column) -> Column:
            total, i = acc["sum"] + x["by"], acc["at"]
            run = F.when(x["hex"], acc["run"] + 1).otherwise(0)
            bits = F.lit(log2(WINDOW)) - total / WINDOW
            place = block * BLOCK - ahead + i + 1 - WINDOW
            added = lambda name, ok: F.when(ok, F.array_append(acc[name], place)).otherwise(acc[name]).alias(name)
            return F.struct(total.alias("sum"), run.alias("run"), (i + 1).alias("at"), added("hex", (run >= WINDOW) & (bits >= HEX_BITS)), added("any", (i + 1 >= WINDOW) & (bits >= ANY_BITS)))

        part = F.slice(chars, block * BLOCK - ahead + 1, ahead + BLOCK)
        folded = F.aggregate(_bind(F.array_join(part, ""), changes), start, step)
        return F.when(F.size(F.array_distinct(part)) >= least, folded)

    hits = F.filter(F.transform(_blocks(F.size(chars)), of), lambda b: b.isNotNull())
    return _bind(hits, lambda bs: F.array(*(F.flatten(F.transform(bs, lambda b: b[name])) for name in ("hex", "any"))))  # noqa: B023


def _merged(starts: Column) -> Column:
    """(start, end) of runs of windows that touch or overlap, from their starts in order."""

    def of(p: Column) -> Column:
        first = F.filter(p, lambda x, j: (j == 0) | (x - F.get(p, j - 1) > WINDOW))
        last = F.filter(p, lambda x, j: (j == F.size(p) - 1) | (F.get(p, j + 1) - x > WINDOW))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b + WINDOW).alias("end")))

    return _bind(starts, of)


def _entropy_spans(text: Column) -> Column:
    """Spans of kind entropy over the candidates of a text."""

    def wanted(x: Column) -> Column:
        path = x["text"].rlike(PATH) & x["text"].rlike(SEPARATOR) & ~x["text"].rlike(SEPARATORS)
        return x["text"].rlike(NEEDS[0]) & x["text"].rlike(NEEDS[1]) & ~x["text"].rlike(UUID) & ~path

    def of(x: Column) -> Column:
        def spans(chars: Column) -> Column:
            def allowed(at: Column) -> Column:
                begin = F.greatest(at + 1 - NEAR, F.lit(1))
                return F.array_join(F.slice(chars, begin, at + 1 + WINDOW + NEAR - begin), "").rlike(ALLOWED)

            starts = F.transform(_window_starts(chars), lambda own: F.filter(own, lambda at: ~allowed(at)))
            return F.flatten(F.transform(starts, _merged))

        hits = _bind(F.split(x["text"], ""), spans)
        return F.transform(hits, lambda h: F.struct((x["start"] + h["start"]).alias("start"), (x["start"] + h["end"]).alias("end"), F.lit(KINDS.index("entropy")).alias("kind")))

    found = F.filter(_located(text, CANDIDATE), wanted)
    return F.array_distinct(F.flatten(F.transform(found, of)))


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy and the matched strings, one row for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    assign = F.filter(_located(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["text"], ASSIGN, 1)) >= LEAST["assign"])
    access = F.filter(_located(text, ACCESS), lambda x: F.length(x["text"]) >= LEAST["access"])
    digits = _located(text, HEX_16)
    rows = rows.select("doc_id", "text", assign.alias("assign"), access.alias("access"), digits.alias("hex"), _entropy_spans(text).alias("entropy"))
    base = F.concat(*(_spans(k, i) for i, k in enumerate(KINDS[:3])))
    return rows.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat(base, F.col("entropy"))).alias("spans"),
        F.size("entropy").cast("long").alias("n_entropy"),
        F.concat(*(F.transform(F.col(k), lambda x: x["text"]) for k in KINDS[:3])).alias("matched"),
    )
