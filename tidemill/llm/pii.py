"""Personal data by boosted trees over overlapping candidate spans, with DataFrame functions alone.

Base spans are the matches of four fixed patterns that pass their checks. High-recall generators
propose further spans that may overlap them and each other: loose and obfuscated addresses, dotted quads
that are defanged or stand inside longer runs, card-like digit groups with any separators and phone-like
groups without a plus. Every candidate has small integer features of its format (digits, groups,
separators, Luhn, marks ...) and context (cue words before it, neighbouring characters). Boosted trees
score it; thresholds calibrated for each kind on held-out rows select the spans that are added. Among
overlapping spans the better score wins, and base spans always stay.

The labels are planted, not taken from the base patterns: into pieces of the corpus' own texts go spans of
the forms in ``FORMS``, which the base patterns miss (addresses with (at) and dot, defanged quads, cards
with other separators or after another number, phones without a plus), and decoys of the forms in
``DECOYS`` (dates, versions, sums, card-like numbers that fail Luhn, sites after "at" ...). A candidate
that equals a planted span is a positive; one that touches a decoy, or a span of another kind, a negative;
candidates that the texts had before are not labelled and left out. About ``ROWS`` such pieces are made,
of at most ``SAMPLE`` documents and more of each where there are fewer (a documented bound), so that fit
and thresholds do not depend on the corpus' size. Half of the rows fit, half calibrate. What comes to the
driver are counts of equal feature vectors, no more than candidates in those rows.
All texts are scored, whole, in one pass of native expressions without a shuffle.

Defined results: a null text is empty and has no spans; an empty table has no model, which adds nothing;
rows are judged alone, so equal rows have equal spans; other columns are ignored. Offsets are code points,
end exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.cluster import held

KINDS = ("email", "ip", "card", "phone")
SAMPLE, ROWS, TREES, DEPTH, RATE = 12_000, 12_000, 20, 4, 0.4
#: Sizes of the blocks of running totals and of the pieces of a text; a place after any.
BLOCK, PIECE, FAR = 32, 256, (1 << 31) - 1
#: Proposals are at most 700 characters and those of one kind never overlap, so that those that overlap
#: one are fewer than this many places from it in the order of starts (700 by the least lengths 5, 7, 13 and 6).
NEAR = 512
#: Precision that a threshold must reach on held-out documents.
PRECISION = 0.95

# Fixed patterns of the base spans. Look-behinds and possessive quantifiers only save work: a match
# that fails at the start of a run of its first class also fails inside the run.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
GENERATORS = {
    "email": r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{1,64}+(?:\x20?(?:@|\(at\)|\[at\])\x20?[A-Z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Z0-9-]{1,63}+){1,8}+|\x20at\x20[A-Z0-9-]{1,63}+(?:(?:\x20dot\x20|\(dot\)|\[dot\]|\.)[A-Z0-9-]{1,63}+){1,8}+)",
    "ip": rf"(?<![0-9]){_OCTET}(?:(?:\.|\[\.\]|\x20?(?:\[dot\]|\(dot\))\x20?){_OCTET}){{3}}(?![0-9])",
    "card": r"(?<![0-9])(?:3[0-9]{3}[\x20.-]?[0-9]{6}[\x20.-]?[0-9]{5}|(?:[0-9]{4}[\x20._/-]?){3}[0-9]{1,7})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00)?[(]?[0-9]{2,4}[)]?(?:[\x20./-]?[0-9]{2,4}){2,4}(?![0-9])",
}
#: A cheap test that a text can have a match of the kind at all.
BASE_HINTS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+"}
HINTS = {"email": r"(?i)@|[(\[]at[)\]]|\x20at\x20", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
CUES = {"email": r"(?i)mail|contact|@|write", "ip": r"(?i)\bip\b|host|server|addr", "card": r"(?i)card|visa|master|amex|credit|pay", "phone": r"(?i)phone|tel|call|mobile|fax|contact"}
MARKS = r"(?i)\(at\)|\[at\]|\(dot\)|\[dot\]|\[\.\]"
BARE = r"(?i)\x20at\x20|\x20dot\x20"
DATE = r"^(?:(?:19|20)[0-9]{2}[./-]?[01][0-9][./-]?[0-3][0-9]|[0-3]?[0-9][\x20./-][0-3]?[0-9][\x20./-](?:19|20)[0-9]{2})(?:[^0-9]|$)"

FEATURES = ("kind", "digits", "seps", "luhn", "lead", "cue", "before", "after", "octets", "varied", "long", "marks", "bare", "groups", "first", "last", "date", "paren", "tight")

#: Planted spans. U and V stand for a drawn word, C for one with a capital, T for an ending, 0 for a digit, 9 for a digit but
#: zero, q for a number below 256 and c for a check digit.
FORMS = {
    "email": ("U (at) V (dot) T", "U[at]V[dot]T", "U.V0 (at) V.T", "U @ V.T", "U0 at V dot T", "U [at] V . T", "U.V at U dot V dot T", "U(at)V(dot)T"),
    "ip": ("q[.]q[.]q[.]q", "q.q.q[.]q", "q (dot) q (dot) q (dot) q", "q[dot]q[dot]q[dot]q"),
    "card": ("9000.0000.0000.000c", "9000_0000_0000_000c", "9000/0000/0000/000c", "3700 000000 0000c", "3700000000 0000c", "9000 0000-0000.000c"),
    "phone": ("(000) 0000-0000", "(090) 000-0000", "090-000-0000", "0049 90 0000000", "090 0000 0000", "090/0000000", "090.000.0000", "090 000 00 00", "0033 9 00 00 00 00"),
}
#: Cards after another number, which the base pattern joins to one run that fails.
AFTER_NUMBER = "9000 0000 0000 000c"
DECOYS = (
    "2090-00-00", "20900000", "00.00.2090", "00/00/1990", "9 000 000", "90 000 000 000", "9.0.0.0.0", "9000 0000 0000 0000", "9000.0000.0000.0000", "9000000000000000", "9000000000", "U at V.T", "U at V. C", "U (at) V", "9000-9000",
    "3700 000000 00000", "00:00:00", "90.00", "900-000", "0-900-00000-0", "q.q.q", "9000/9000/9000/9000", "90 90 90 90", "9000 9000", "U at V dot", "12 24 36 48 60",
)
WORDS = ("info", "anna", "office", "kim", "sales", "jo", "support", "peter", "web", "news", "post", "mail", "north", "blue", "home", "data")
ENDINGS = ("com", "org", "net", "de", "fr", "es", "io", "co")
BEFORE = {"email": ("mail ", "contact: ", "write to "), "ip": ("host ", "server ", "IP "), "card": ("card ", "Visa: ", "paid with "), "phone": ("tel ", "call ", "phone: "), "": ("no. ", "on ", "ref ")}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, total: Callable[[Column], Column], zero: int) -> Column:
    """The totals (sum, max or min) of all beginnings of an array of ints, by blocks, so that cost is near linear."""

    def blocks(v: Column) -> Column:
        last = F.greatest(F.floor((F.size(v) - 1) / BLOCK), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda j: F.slice(v, j * BLOCK + 1, F.lit(BLOCK)))

    def within(before: Column, c: Column) -> Column:
        return F.transform(c, lambda x, i: total(F.concat(F.array(before), F.slice(c, F.lit(1), i + 1))))

    def joined(c: Column, tops: Column) -> Column:
        return F.flatten(F.transform(c, lambda x, j: bound(total(F.concat(F.array(F.lit(zero)), F.slice(tops, F.lit(1), j))), lambda t: within(t, x))))

    return bound(values, lambda v: bound(blocks(v), lambda c: bound(F.transform(c, lambda x: total(F.concat(F.array(F.lit(zero)), x))), lambda tops: joined(c, tops))))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0), lambda a, x: a + x)


def located(text: Column, pattern: str) -> Column:
    """array<struct<m string, s int>>: the matches and their start in code points, leftmost and non-overlapping."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def placed(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: F.length(x["g"]) + F.length(x["m"])), _sum, 0)
        return F.zip_with(p, ends, lambda x, e: F.struct(x["m"].alias("m"), (e - F.length(x["m"])).alias("s")))

    return bound(F.filter(parts, lambda x: x["m"].isNotNull()), placed)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def octets_ok(m: Column) -> Column:
    """All parts of a dotted number at most 255, whatever their leading zeros."""

    def small(p: Column) -> Column:
        bare = F.ltrim(p, F.lit("0"))
        return F.when(F.length(bare) <= 3, F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255).otherwise(False)

    return F.forall(F.split(m, "\\."), small)


def passes(kind: str, m: Column) -> Column:
    """The check of a base match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return octets_ok(m)
    n = F.length(digits_of(m))
    if kind == "phone":
        return n.between(8, 15)
    return F.when(n.between(16, 19), F.call_function("luhn_check", digits_of(m))).otherwise(False)


def _hinted(hint: str, text: Column, found: Column) -> Column:
    return F.when(F.rlike(text, F.lit(hint)), found).otherwise(F.array().cast("array<struct<m:string,s:int>>"))


def base_spans(text: Column) -> dict[str, Column]:
    def checked(kind: str) -> Column:
        return F.filter(_hinted(BASE_HINTS[kind], text, located(text, BASE[kind])), lambda x: passes(kind, x["m"]))

    return {k: checked(k) for k in KINDS}


def _code(c: Column) -> Column:
    """0 none, 1 space, 2 letter, 3 digit, 4 other"""
    return F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike("\\s"), 1).when(c.rlike("\\p{L}"), 2).when(c.rlike("[0-9]"), 3).otherwise(4)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _described(kind: str, pieces: Column, x: Column, proposed: int) -> Column:
    """A candidate's place, whether it was proposed or is a base span (0), and features, all small integers."""
    m, s = x["m"], x["s"]
    d = digits_of(m)
    n = F.length(d)
    e = s + F.length(m)

    def piece(i: Column) -> Column:
        return F.coalesce(F.get(pieces, i.cast("int")), F.lit(""))

    # places in the whole text would be found by counting from its start; the pieces are PIECE characters each
    left = F.greatest(s - 24, F.lit(0))
    i = F.floor(left / PIECE)
    around = F.substring(F.concat(piece(i), piece(i + 1)), left - i * PIECE + 1, s - left)
    j = F.floor(e / PIECE)
    after = F.substring(piece(j), e - j * PIECE + 1, F.lit(1))
    return F.struct(
        s.alias("s"),
        e.alias("e"),
        F.lit(KINDS.index(kind)).alias("kind"),
        F.lit(proposed).alias("proposed"),
        F.least(n, F.lit(20)).alias("digits"),
        F.least(F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), F.lit(8)).alias("seps"),
        F.when(n.between(12, 19), F.call_function("luhn_check", d)).otherwise(False).cast("int").alias("luhn"),
        F.when(m.startswith("+"), 2).when(m.startswith("00"), 1).otherwise(0).alias("lead"),
        F.rlike(around, F.lit(CUES[kind])).cast("int").alias("cue"),
        _code(F.right(around, F.lit(1))).alias("before"),
        _code(after).alias("after"),
        (m.rlike(r"^[0-9]+(\.[0-9]+){3}$") & octets_ok(F.when(m.rlike(r"^[0-9.]+$"), m).otherwise("0"))).cast("int").alias("octets"),
        F.least(F.size(F.array_distinct(F.split(d, ""))), F.lit(6)).alias("varied"),
        F.least((F.length(m) / 4).cast("int"), F.lit(12)).alias("long"),
        F.least(F.regexp_count(m, F.lit(MARKS)), F.lit(8)).cast("int").alias("marks"),
        F.least(F.regexp_count(m, F.lit(BARE)), F.lit(8)).cast("int").alias("bare"),
        F.least(F.regexp_count(m, F.lit("[0-9]+")), F.lit(12)).cast("int").alias("groups"),
        F.least(F.length(F.regexp_extract(m, "[0-9]+", 0)), F.lit(20)).cast("int").alias("first"),
        F.least(F.length(F.regexp_extract(m, "([0-9]+)[^0-9]*$", 1)), F.lit(20)).cast("int").alias("last"),
        F.rlike(m, F.lit(DATE)).cast("int").alias("date"),
        F.contains(m, F.lit("(")).cast("int").alias("paren"),
        # an address whose last part stands close to its dot
        F.rlike(m, F.lit(r"[^\x20]\.[A-Za-z]{2,6}$")).cast("int").alias("tight"),
    )


def candidates(text: Column, pieces: Column, base: dict[str, Column]) -> Column:
    """Base spans and proposals of all generators, described, each span and kind once, by start.

    ``touch`` tells whether a span overlaps a base span: one that starts no later and ends after its
    start, or one that starts later and before its end.
    """

    def of(kind: str) -> Column:
        found = _hinted(HINTS[kind], text, located(text, GENERATORS[kind]))
        return F.concat(F.transform(base[kind], lambda x: _described(kind, pieces, x, 0)), F.transform(found, lambda x: _described(kind, pieces, x, 1)))

    def single(c: Column) -> Column:
        return F.filter(c, lambda x, i: (i == 0) | ~_same(x, F.get(c, i - 1)))

    def touched(c: Column) -> Column:
        ends = running(F.transform(c, lambda x: F.when(x["proposed"] == 0, x["e"]).otherwise(-1)), F.array_max, -1)
        starts = F.reverse(running(F.reverse(F.transform(c, lambda x: F.when(x["proposed"] == 0, x["s"]).otherwise(FAR))), F.array_min, FAR))
        return bound(ends, lambda p: bound(starts, lambda q: F.transform(c, lambda x, i: x.withField("touch", (F.get(p, i) > x["s"]) | (F.get(q, i) < x["e"])))))

    # a base span sorts before the equal proposal
    return bound(F.array_sort(F.concat(*[of(k) for k in KINDS])), lambda c: bound(single(c), touched))


@dataclass
class Tree:
    """A node tests feature <= cut; a leaf has a value."""

    value: float = 0.0
    feature: int = -1
    cut: int = 0
    low: Tree | None = None
    high: Tree | None = None

    def score(self, x: tuple[int, ...]) -> float:
        if self.low is None or self.high is None:
            return self.value
        return (self.low if x[self.feature] <= self.cut else self.high).score(x)

    def column(self, c: Column) -> Column:
        if self.low is None or self.high is None:
            return F.lit(self.value)
        return F.when(c[FEATURES[self.feature]] <= self.cut, self.low.column(c)).otherwise(self.high.column(c))


@dataclass
class Model:
    start: float = -3.0
    trees: list[Tree] = field(default_factory=list)
    bars: tuple[float, ...] = (1e9, 1e9, 1e9, 1e9)

    def score(self, x: tuple[int, ...]) -> float:
        return self.start + sum(t.score(x) for t in self.trees)

    def column(self, c: Column) -> Column:
        out = F.lit(self.start)
        for t in self.trees:
            out = out + t.column(c)
        return out

    def bar(self, c: Column) -> Column:
        out = F.lit(self.bars[-1])
        for k in range(len(KINDS) - 1):
            out = F.when(c["kind"] == k, F.lit(self.bars[k])).otherwise(out)
        return out


def _grow(cells: list[tuple[tuple[int, ...], float, float]], depth: int) -> Tree:
    """A regression tree over (features, gradient sum, hessian sum), by second-order gain."""
    g, h = sum(c[1] for c in cells), sum(c[2] for c in cells)
    leaf = Tree(round(-RATE * g / (h + 1.0), 9))
    if depth == 0 or len(cells) < 2:
        return leaf
    best: tuple[float, int, int] | None = None
    for f in range(len(FEATURES)):
        sums: dict[int, list[float]] = {}
        for x, a, b in cells:
            s = sums.setdefault(x[f], [0.0, 0.0])
            s[0] += a
            s[1] += b
        gl = hl = 0.0
        for v in sorted(sums)[:-1]:
            gl, hl = gl + sums[v][0], hl + sums[v][1]
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                best = (gain, f, v)
    if best is None:
        return leaf
    _, f, cut = best
    return Tree(leaf.value, f, cut, _grow([c for c in cells if c[0][f] <= cut], depth - 1), _grow([c for c in cells if c[0][f] > cut], depth - 1))


def boost(cells: list[tuple[tuple[int, ...], int, int, int]]) -> Model:
    """A model from rows (features, fold, positives, negatives): fold 0 fits, fold 1 calibrates.

    The threshold of a kind is the least score from which on the held-out rows reach the precision; a kind
    without held-out positives adds nothing.
    """
    fit = [(x, p, n) for x, fold, p, n in sorted(cells) if fold == 0]
    pos, neg = sum(p for _, p, _ in fit), sum(n for _, _, n in fit)
    if not pos:
        return Model()
    model = Model(start=math.log((pos + 1) / (neg + 1)))
    scores = [model.start] * len(fit)
    for _ in range(TREES):
        rows = []
        for (x, p, n), s in zip(fit, scores, strict=True):
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))
            rows.append((x, q * (p + n) - p, q * (1 - q) * (p + n)))
        tree = _grow(rows, DEPTH)
        model.trees.append(tree)
        scores = [s + tree.score(x) for (x, _, _), s in zip(fit, scores, strict=True)]
    held = [(x, p, n) for x, fold, p, n in sorted(cells) if fold == 1] or fit
    bars = []
    for k in range(len(KINDS)):
        own = sorted(((model.score(x), p, n) for x, p, n in held if x[0] == k), reverse=True)
        bar, tp, seen, i = 1e9, 0, 0, 0
        while i < len(own):
            s = own[i][0]
            while i < len(own) and own[i][0] == s:
                tp, seen, i = tp + own[i][1], seen + own[i][1] + own[i][2], i + 1
            if tp and tp / seen >= PRECISION:
                bar = s
        bars.append(bar)
    model.bars = tuple(round(b - 1e-6, 6) for b in bars)
    return model


def _prepared(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"), *more)
    rows = rows.withColumns({f"_{k}": c for k, c in base_spans(F.col("_t")).items()})
    rows = rows.withColumn("_p", _pieces(F.col("_t")))
    return rows.withColumn("_c", candidates(F.col("_t"), F.col("_p"), {k: F.col(f"_{k}") for k in KINDS})).drop("_p")


def _bases() -> Column:
    """All base spans of a prepared row by kind, then start."""

    def of(i: int) -> Column:
        return F.transform(F.col(f"_{KINDS[i]}"), lambda x: F.struct(F.lit(i).alias("kind"), x["s"].alias("s"), (x["s"] + F.length(x["m"])).alias("e")))

    return F.concat(*[of(i) for i in range(len(KINDS))])


def _same(a: Column, b: Column) -> Column:
    return (a["kind"] == b["kind"]) & (a["s"] == b["s"]) & (a["e"] == b["e"])


def _touch(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def _number(seed: Column, what: Column | str, below: int) -> Column:
    """A drawn number, from a hash of the seed."""
    return F.pmod(F.xxhash64(seed, F.lit(what) if isinstance(what, str) else what), F.lit(below))


def _pick(seed: Column, what: Column | str, of: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, of)), (_number(seed, what, len(of)) + 1).cast("int"))


def _written(form: Column, seed: Column) -> Column:
    """A form with its letters drawn; a check digit makes all digits before it pass Luhn."""

    def drawn(ch: Column, i: Column) -> Column:
        word = _pick(seed, i, WORDS)
        number = F.when(ch == "0", _number(seed, i, 10)).when(ch == "9", _number(seed, i, 9) + 1).when(ch == "q", _number(seed, i, 256)).cast("string")
        return F.when(ch.isin("0", "9", "q"), number).when(ch.isin("U", "V"), word).when(ch == "C", F.initcap(word)).when(ch == "T", _pick(seed, i, ENDINGS)).when(ch != "c", ch).otherwise("")

    def checked(body: Column) -> Column:
        fits = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: F.call_function("luhn_check", F.concat(digits_of(body), c.cast("string"))))
        return F.when(F.contains(form, F.lit("c")), F.concat(body, F.element_at(fits, 1).cast("string"))).otherwise(body)

    return bound(F.array_join(F.transform(F.split(form, ""), drawn), ""), checked)


def planted(docs: DataFrame, id_col: str, text_col: str, sample: int, rows: int) -> DataFrame:
    """Pieces of the texts with one planted span each: (_id, _t, plant: struct<kind, s, e>), kind -1 for a decoy."""
    total = docs.count()
    keyed = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    if total > sample:
        keyed = keyed.where(F.pmod(F.xxhash64("i", "t"), F.lit(1 << 30)) < int(sample / total * (1 << 30)))
    each = -(-rows // max(1, min(total, sample)))
    drawn = keyed.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(each)))).withColumn("seed", F.xxhash64("i", F.xxhash64("t"), "n"))
    # a piece of the text at a drawn place, cut at its middle space
    place = _number(F.col("seed"), "place", 1 << 30) % F.greatest(F.length("t") - 160, F.lit(1))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    drawn = held(drawn.repartition(parts, "seed").select("seed", F.split(F.substring("t", (place + 1).cast("int"), F.lit(160)), r"\s+").alias("words")))
    seed = F.col("seed")
    cases = [(i, form, "") for i, k in enumerate(KINDS) for form in FORMS[k]] + [(KINDS.index("card"), AFTER_NUMBER, "after")]
    # as many decoys as spans
    spans = len(cases)
    cases += [(-1, form, "any") for form in DECOYS]
    which = F.when(_number(seed, "decoy", 2) == 0, _number(seed, "form", spans)).otherwise(_number(seed, "form", len(DECOYS)) + spans).cast("int")
    table = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(form).alias("form"), F.lit(lead).alias("lead")) for k, form, lead in cases])
    drawn = held(drawn.select("seed", "words", F.element_at(table, which + 1).alias("x")))
    own = F.lit("")
    for i, k in enumerate(KINDS):
        own = F.when(F.col("x.kind") == i, _pick(seed, "cue word", BEFORE[k])).otherwise(own)
    # decoys stand after any cue, and after none that tells as often as not
    other = F.when(_number(seed, "odd cue", 2) == 0, _pick(seed, "cue word", tuple(c for k in KINDS for c in BEFORE[k]))).otherwise(_pick(seed, "cue word", BEFORE[""]))
    cue = F.when(F.col("x.lead") == "after", F.concat((_number(seed, "number", 90) + 10).cast("string"), F.lit(" ")))
    cue = cue.when(_number(seed, "cue", 2) == 0, F.lit("")).when(F.col("x.lead") == "any", other).otherwise(own)
    half = F.floor(F.size("words") / 2).cast("int")
    left, right = F.array_join(F.slice("words", F.lit(1), half), " "), F.array_join(F.slice("words", half + 1, F.size("words")), " ")
    made = held(drawn.select("seed", F.concat(left, F.lit(" "), cue).alias("before"), _written(F.col("x.form"), seed).alias("span"), F.concat(_pick(seed, "end", (" ", ". ", ", ", "; ", ") ")), right).alias("after"), "x.kind"))
    plant = F.struct("kind", F.length("before").alias("s"), (F.length("before") + F.length("span")).alias("e"))
    return held(made.select(seed.alias("_id"), F.concat("before", "span", "after").alias("_t"), plant.alias("plant")))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, rows: int = ROWS) -> Model:
    made = planted(docs, id_col, text_col, sample, rows)
    found = _prepared(made, "_id", "_t", "plant").withColumn("_f", F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(2)).cast("int"))
    marked = found.select("_f", "plant", F.explode("_c").alias("c")).where("NOT c.touch AND c.s < plant.e AND plant.s < c.e")
    marked = marked.withColumn("p", F.expr("c.kind = plant.kind AND c.s = plant.s AND c.e = plant.e")).where("p OR c.kind != plant.kind")
    cells = marked.groupBy("_f", *[F.col(f"c.{x}").alias(x) for x in FEATURES]).agg(F.count_if("p").alias("p"), F.count_if(~F.col("p")).alias("n"))
    return boost([(tuple(r[x] for x in FEATURES), r["_f"], r["p"], r["n"]) for r in cells.collect()])


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))))


def _best(spans: Column) -> Column:
    """The spans, given by start, that overlap none better; only those of one chain of overlaps are compared."""

    def better(o: Column) -> Column:
        return F.struct(o["score"], o["e"] - o["s"], -o["s"], -o["kind"])

    def chained(c: Column, ends: Column) -> Column:
        cut = lambda x, i: F.coalesce(F.get(ends, i - 1) <= x["s"], F.lit(True))
        first = running(F.transform(c, lambda x, i: F.when(cut(x, i), i).otherwise(0)), F.array_max, 0)
        return bound(first, lambda f: F.filter(c, lambda x, i: ~F.exists(near(c, f, i), lambda o: _touch(o, x) & (better(o) > better(x)))))

    def near(c: Column, first: Column, i: Column) -> Column:
        # those before in the chain, and at least those after that start before this one's end
        from_ = F.greatest(F.get(first, i), i - NEAR)
        return F.slice(c, from_ + 1, i - from_ + 1 + _later(c, i))

    def _later(c: Column, i: Column) -> Column:
        step = lambda k: F.coalesce(F.get(c, i + k)["s"] < F.get(c, i)["e"], F.lit(False))
        return F.when(~step(1), 0).when(~step(4), 3).when(~step(32), 31).otherwise(NEAR)

    return bound(running(F.transform(spans, lambda x: x["e"]), F.array_max, -1), lambda ends: chained(spans, ends))


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, base, added)``: arrays of struct<kind, s, e>, each sorted by kind and start."""
    rows = _prepared(docs, id_col, text_col).withColumn("_b", _bases())
    free = F.filter("_c", lambda c: ~c["touch"])
    scored = F.transform(free, lambda c: F.struct(model.column(c).alias("score"), model.bar(c).alias("bar"), c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")))
    rows = rows.withColumn("_s", F.filter(scored, lambda c: c["score"] >= c["bar"]))

    kept = F.transform(F.when(F.size("_s") < 2, F.col("_s")).otherwise(_best(F.col("_s"))), lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")))
    added = F.array_sort(kept)
    return rows.select(F.col("_id").alias(id_col), F.col("_b").alias("base"), added.alias("added"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; what overlapping spans cover goes once."""

    def cut(pieces: Column, at: Column, to: Column) -> Column:
        first = F.floor(at / PIECE).cast("int")
        some = F.slice(pieces, first + 1, F.floor(to / PIECE).cast("int") - first + 1)
        return F.substring(F.array_join(some, ""), at - first * PIECE + 1, to - at)

    def whole(pieces: Column, found: Column, ends: Column) -> Column:
        end = lambda i: F.coalesce(F.get(ends, i), F.lit(0))
        name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
        shown = F.transform(found, lambda x, i: F.concat(cut(pieces, end(i - 1), F.greatest(x["s"], end(i - 1))), F.lit("["), name(x), F.lit("]")))
        return F.concat(F.array_join(shown, ""), cut(pieces, end(F.size(found) - 1), F.length(text)))

    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return bound(_pieces(text), lambda p: bound(ordered, lambda c: bound(running(F.transform(c, lambda x: x["e"]), F.array_max, 0), lambda ends: whole(p, c, ends))))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans, the hash of their list, and the list of all spans."""
    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    whole = F.array_sort(F.concat("base", "added"))
    return found.select(id_col, *[count(i) for i in range(len(KINDS))], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(whole).alias("spans"))
