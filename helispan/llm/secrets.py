"""Secret scans in SQL functions only: three fixed patterns, and entropy of candidate strings.

Positions are code points. SQL functions give matches but no positions, so a text is split by the
pattern that also extracts the matches, and running sums of the lengths of pieces and matches are
the positions.

The added method takes strings of 20 or more characters of keys, at least one digit and one letter
among them, and slides a window of 20 characters over each. The fold over a string keeps the count
of every character in the window, and for each character class (digits, lower case, upper case,
marks) the number of its characters and their part of the entropy; a step takes one character out
and one in. A string is a secret if some window has entropy enough as a whole, each class of which
there are characters enough is spread over its own alphabet, and no allow-list pattern suppresses it.

Work is linear in a text, or nearly so: running sums over m matches are made in blocks of sqrt(m).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds in their order, their patterns, and what a text must contain to be searched.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{16,}",
}
HINTS = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": "AKIA", "hex": r"[0-9a-f]{16}"}
LEAST = {"assign": 12, "access": 18, "hex": 16}
_KEY = "A-Za-z0-9+/_-"
CANDIDATE = rf"(?<![{_KEY}])[{_KEY}]{{20,}}"
#: A candidate may be a secret only if a digit and a letter are among its characters.
CANDIDATE_HINT = rf"(?<![{_KEY}])(?=[{_KEY}]*[0-9])(?=[{_KEY}]*[A-Za-z])[{_KEY}]{{20}}"
WINDOW = 20
#: Least bits of a window, by the alphabet of the string: one case of hexadecimal digits, or more.
MIN_ENTROPY = {"hex": 2.9, "other": 3.6}
#: The character classes.
CLASSES = {"digit": "0123456789", "lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "mark": "+/_-"}
#: Letters of a class that hexadecimal strings use.
HEX_LETTERS = 6
#: Characters of a class in a window from which its own entropy counts, and its least share of what its alphabet allows.
CLASS_CHARS, CLASS_SHARE = 6, 0.6
#: Strings that are not secrets: documented samples, paths of words, words joined by dashes, identifiers in the 8-4-4-4-12 form.
ALLOWED = [
    r"(?i)example|sample|dummy|placeholder|xxxx",
    rf"^/?+(?:[A-Z]?+[a-z]++(?:[_-][A-Z]?+[a-z]++)*+/)++[A-Za-z0-9_-]{{0,{WINDOW - 1}}}$",
    r"^[a-z]++(?:[-_][a-z0-9]++)++$",
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
]
MASK = "[SECRET]"
_SPAN = "array<struct<start:int,stop:int,kind:string,text:string>>"

#: A count takes 5 bits, twelve of them a word; words of one class follow each other.
_BITS, _PER_WORD = 5, 12
_WORD_CLASS = [c for c, chars in enumerate(CLASSES.values()) for _ in range(-(-len(chars) // _PER_WORD))]
#: By character code: the word and the shift of its count.
_PLACE = {ord(x): (_WORD_CLASS.index(c) + i // _PER_WORD, _BITS * (i % _PER_WORD)) for c, chars in enumerate(CLASSES.values()) for i, x in enumerate(chars)}
#: Parts of the entropy are whole numbers of this unit, so that sums are exact.
_UNIT = 1 << 32
_COST = [round(n * math.log2(n) * _UNIT) if n else 0 for n in range(WINDOW + 1)]


def _class_limits(hexadecimal: bool) -> list[int]:
    """By class and number of its characters in a window: the most that n log2 n of their counts may add up to."""
    out = []
    for name, chars in CLASSES.items():
        letters = min(len(chars), HEX_LETTERS) if hexadecimal and name in ("lower", "upper") else len(chars)
        out += [_COST[n] if n < CLASS_CHARS else round((math.log2(n) - CLASS_SHARE * math.log2(min(n, letters))) * n * _UNIT) for n in range(WINDOW + 1)]
    return out


def _literal(values: list[int], kind: str) -> Column:
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(values: Column, body: Callable[[Column], Column]) -> Column:
    """The values in blocks of about the square root of their number, each through ``body``; null for none."""

    def cut(v: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        return _let(step, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / s).cast("int")), lambda b: body(F.slice(v, b * s + 1, s))))

    return F.when(F.size(values) > 0, _let(values, cut))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running results of ``combine`` over an array of integers from 0 on."""

    def scan(block: Column) -> Column:
        return F.aggregate(F.slice(block, 2, F.size(block)), F.slice(block, 1, 1), lambda a, x: F.concat(a, F.array(combine(F.element_at(a, -1), x))))

    def carried(inner: Column) -> Column:
        before = F.aggregate(inner, F.array(F.lit(0)), lambda a, r: F.concat(a, F.array(combine(F.element_at(a, -1), F.element_at(r, -1)))))
        return F.flatten(F.zip_with(inner, F.slice(before, 1, F.size(inner)), lambda r, c: F.transform(r, lambda x: combine(c, x))))

    return F.coalesce(_let(_blocks(values, scan), carried), F.array().cast("array<int>"))


def _none() -> Column:
    return F.array().cast(_SPAN)


def _spans(text: Column, pattern: str, hint: str, kind: str) -> Column:
    """Matches of a pattern as (start, stop, kind, text), leftmost and not overlapping."""

    def of(found: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda p, m: F.length(p) + F.length(m))
        stops = running(lengths, lambda a, b: a + b)
        return F.zip_with(found, stops, lambda m, stop: F.struct((stop - F.length(m)).alias("start"), stop.alias("stop"), F.lit(kind).alias("kind"), m.alias("text")))

    return F.when(F.rlike(text, F.lit(hint)), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)).otherwise(_none())


def window_entropy(s: Column, hexadecimal: Column) -> Column:
    """Of a string of key characters: ``best``, the highest entropy of its windows in bits, and ``spread``.

    ``spread`` tells whether some window reaches the least entropy of its alphabet with every class spread.
    """
    words = _literal([_PLACE.get(i, (0, 0))[0] for i in range(128)], "int")
    steps = _literal([1 << _PLACE.get(i, (0, 0))[1] for i in range(128)], "bigint")
    shifts = _literal([_PLACE.get(i, (0, 0))[1] for i in range(128)], "int")
    classes = _literal(_WORD_CLASS, "int")
    gains = _literal([b - a for a, b in zip(_COST, _COST[1:], strict=False)], "bigint")
    most = {k: round((math.log2(WINDOW) - v) * WINDOW * _UNIT) for k, v in MIN_ENTROPY.items()}
    limit = F.when(hexadecimal, F.lit(most["hex"])).otherwise(F.lit(most["other"])).cast("bigint")
    limits = F.when(hexadecimal, _literal(_class_limits(True), "bigint")).otherwise(_literal(_class_limits(False), "bigint"))

    def move(code: Column, sign: int) -> Column:
        word = F.element_at(words, code + 1)
        return F.struct(word.alias("word"), F.element_at(classes, word + 1).alias("class"), F.element_at(shifts, code + 1).alias("shift"), (F.element_at(steps, code + 1) * sign).alias("step"), F.lit(sign).alias("sign"))

    def moves(codes: Column) -> Column:
        first = F.transform(F.slice(codes, 1, WINDOW), lambda c: move(c, 1))
        rest = F.slice(codes, WINDOW + 1, F.size(codes))
        return F.concat(first, F.flatten(F.zip_with(F.slice(codes, 1, F.size(rest)), rest, lambda out, new: F.array(move(out, -1), move(new, 1)))))

    def seen(acc: Column, full: Column) -> tuple[Column, Column]:
        """Least total and verdict after the window of ``acc``, where it is full."""
        total = F.aggregate(acc["sums"], F.lit(0).cast("bigint"), lambda a, x: a + x)
        even = F.forall(F.sequence(F.lit(0), F.lit(len(CLASSES) - 1)), lambda c: F.element_at(acc["sums"], c + 1) <= F.element_at(limits, c * (WINDOW + 1) + F.element_at(acc["sizes"], c + 1) + 1))
        return F.when(full, F.least(acc["least"], total)).otherwise(acc["least"]), acc["spread"] | (full & (total <= limit) & even)

    def step(acc: Column, e: Column) -> Column:
        least, spread = seen(acc, e["sign"] < 0)
        count = F.call_function("shiftright", F.element_at(acc["words"], e["word"] + 1), e["shift"]).bitwiseAND(F.lit((1 << _BITS) - 1).cast("bigint"))
        gain = F.element_at(gains, count.cast("int") + F.when(e["sign"] > 0, 1).otherwise(0)) * e["sign"]
        return F.struct(
            F.transform(acc["words"], lambda w, i: F.when(i == e["word"], w + e["step"]).otherwise(w)).alias("words"),
            F.transform(acc["sums"], lambda x, i: F.when(i == e["class"], x + gain).otherwise(x)).alias("sums"),
            F.transform(acc["sizes"], lambda x, i: F.when(i == e["class"], x + e["sign"]).otherwise(x)).alias("sizes"),
            least.alias("least"), spread.alias("spread"),
        )

    def last(acc: Column) -> Column:
        least, spread = seen(acc, F.lit(True))
        return F.struct((F.lit(math.log2(WINDOW)) - least / F.lit(float(WINDOW * _UNIT))).alias("best"), spread.alias("spread"))

    start = F.struct(
        _literal([0] * len(_WORD_CLASS), "bigint").alias("words"), _literal([0] * len(CLASSES), "bigint").alias("sums"), _literal([0] * len(CLASSES), "int").alias("sizes"),
        F.lit(2 * _COST[WINDOW]).cast("bigint").alias("least"), F.lit(False).alias("spread"),
    )
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), F.ascii)
    return F.aggregate(_let(codes, moves), start, step, last)


def _is_secret(s: Column) -> Column:
    mixed = s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    for pattern in ALLOWED:
        mixed = mixed & ~s.rlike(pattern)
    return F.when(mixed, window_entropy(s, s.rlike("^(?:[0-9a-f]++|[0-9A-F]++)$"))["spread"]).otherwise(F.lit(False))


def secret_spans(text: Column) -> Column:
    """``base`` and ``more``: spans (start, stop, kind, text) of the fixed patterns, and of the entropy method.

    A null or empty text has none. Candidates that a base span already covers are not added again.
    """
    text = F.coalesce(text, F.lit(""))
    spans = {k: _spans(text, p, HINTS[k], k) for k, p in PATTERNS.items()}
    long_value = F.filter(spans["assign"], lambda x: F.length(F.regexp_extract(x["text"], PATTERNS["assign"], 1)) >= LEAST["assign"])
    long_key = F.filter(spans["access"], lambda x: F.length(x["text"]) >= LEAST["access"])
    base = F.concat(long_value, long_key, spans["hex"])

    def open_(base: Column, found: Column) -> Column:
        """Candidates that reach beyond every base span that begins no later."""
        given = F.transform(base, lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("rank"), x["stop"].alias("stop"), F.lit("").alias("text")))
        asked = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("rank"), x["stop"].alias("stop"), x["text"].alias("text")))

        def beyond(rows: Column) -> Column:
            reach = running(F.transform(rows, lambda x: F.when(x["rank"] == 0, x["stop"]).otherwise(F.lit(0))), F.greatest)
            pairs = F.zip_with(rows, reach, lambda x, r: F.struct(x.alias("x"), r.alias("r")))
            return F.transform(F.filter(pairs, lambda p: (p["x"]["rank"] == 1) & (p["r"] < p["x"]["stop"])), lambda p: p["x"])

        return F.when(F.size(found) > 0, _let(F.sort_array(F.concat(given, asked)), beyond)).otherwise(F.array().cast("array<struct<start:int,rank:int,stop:int,text:string>>"))

    def both(base: Column) -> Column:
        secret = F.filter(open_(base, _spans(text, CANDIDATE, CANDIDATE_HINT, "entropy")), lambda x: _is_secret(x["text"]))
        more = F.transform(secret, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.lit("entropy").alias("kind"), x["text"].alias("text")))
        return F.struct(base.alias("base"), more.alias("more"))

    return _let(base, both)


def find_secrets(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """The documents with a column ``into`` of ``secret_spans``; a column of that name is replaced."""
    return docs.withColumn(into, secret_spans(F.col(text)))


def _listed(spans: Column) -> Column:
    order = F.create_map(*[F.lit(v) for i, k in enumerate([*PATTERNS, "entropy"]) for v in (k, i)])
    rows = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"], order[x["kind"]], x["stop"], x["kind"].alias("k"))))
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["k"], x["start"], x["stop"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, a hash of its base spans, and all its spans as a string.

    A null ``doc_id`` stays null, repeated rows repeat, other columns are ignored.
    """
    d = docs.select("doc_id", secret_spans(F.col("text")).alias("s")).select("doc_id", F.col("s.base").alias("base"), F.col("s.more").alias("more"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return d.select("doc_id", *map(count, PATTERNS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "more")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """A text with the spans masked, those that overlap as one."""

    def gaps(rows: Column) -> Column:
        reach = running(F.transform(rows, lambda x: x["stop"]), F.greatest)

        def between(reach: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), F.slice(reach, 1, F.size(reach) - 1))
            after = F.concat(F.transform(F.slice(rows, 2, F.size(rows)), lambda x: x["start"]), F.array(F.length(text) + 1))
            starts = F.transform(F.filter(F.zip_with(rows, before, lambda x, b: F.struct(x["start"].alias("at"), b.alias("b"))), lambda p: p["at"] >= p["b"]), lambda p: p["at"])
            stops = F.transform(F.filter(F.zip_with(reach, after, lambda r, a: F.struct(r.alias("at"), a.alias("a"))), lambda p: p["a"] >= p["at"]), lambda p: p["at"])
            return F.zip_with(F.concat(F.array(F.lit(0)), stops), F.concat(starts, F.array(F.length(text))), lambda f, t: F.struct(f.alias("f"), t.alias("t")))

        return _let(reach, between)

    def pieces(block: Column) -> Column:
        """Pieces are cut from a stretch of the text, as each cut walks from the start of what it is cut from."""
        first, stretch = block[0]["f"], text.substr(block[0]["f"] + 1, F.element_at(block, -1)["t"] - block[0]["f"])
        return _let(stretch, lambda part: F.transform(block, lambda p: part.substr(p["f"] - first + 1, p["t"] - p["f"])))

    return F.array_join(F.flatten(_blocks(gaps(spans), pieces)), MASK)


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents with every secret span masked and ``n_chars``, where there is one, counted anew.

    Spans that overlap are masked as one; a text without secrets, or null, stays as it is.
    """
    columns = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(columns)])
    old = F.col(f"_k{columns.index(text)}")
    d = own.withColumn("_f", secret_spans(old))
    d = d.withColumn("_s", F.sort_array(F.transform(F.concat("_f.base", "_f.more"), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))))
    d = d.withColumn("_m", F.when(F.size("_s") > 0, masked(old, F.col("_s"))).otherwise(old))
    out = []
    for i, c in enumerate(columns):
        if c == text:
            out.append(F.col("_m").alias(c))
        elif c == n_chars:
            out.append(F.when(F.size("_s") > 0, F.length("_m").cast(docs.schema[c].dataType)).otherwise(F.col(f"_k{i}")).alias(c))
        else:
            out.append(F.col(f"_k{i}").alias(c))
    return d.select(*out)
