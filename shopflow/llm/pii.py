"""Personal data by weak supervision, with DataFrame functions only.

Method. Labelers vote on candidate spans: strict formats (regex), gazetteers
(top-level domains, issuer prefixes, country codes, titles), the words before a
span (context), and how it is set off from its surroundings. Expectation
maximisation over the counted vote patterns estimates each labeler's
reliability and every pattern's posterior; a logistic span classifier, with the
kind and the votes as features, is trained on those posteriors and decides on
candidates. Spans of the four base kinds (email, ip, card, phone) that meet
their definition always stay; the classifier can only add spans, of the kinds
ssn, iban, secret, name, and phone numbers without a country code.

Scale. Spans are found by a map over rows; only counted vote patterns are
shuffled, at most 3^4 per kind. EM and the classifier run on that bounded table
as one row of arrays. Patterns use possessive loops, so long runs neither
recurse nor go quadratic; offsets are running sums in blocks, surroundings come
from what lies between matches, and overlaps are found by halving, so the work
on a text grows with its length and its spans.

Edge cases. Null text is empty and has no spans. Offsets are code points, ends
exclusive. Without any candidate the classifier adds nothing. Repeated rows each
give a row; other columns are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import cells, let, piece, running
from .shared import materialize

# The kinds in their order, and their patterns.
BASE = ("email", "ip", "card", "phone")
ADDED = ("ssn", "iban", "secret", "name", "local_phone")
KINDS = BASE + ADDED
PATTERNS = {
    # a start inside a run of name characters can only match where the run's start can, unless a match has just ended there
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{24,}+",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señora?|Sra?)\.?\x20\p{Lu}\p{L}++(?:\x20\p{Lu}\p{L}++)?",
    "local_phone": r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
}
#: A kind is looked for only in texts that hold what each of its matches must hold.
NEEDS = {"email": "@", "phone": "+", "ssn": "-", "iban": r"[A-Z]{2}[0-9]{2}", "secret": r"[A-Za-z0-9_/+=-]{24}", "name": r"(?:r|rs|s|of|rr|au|me|eur|ra|or)\.?\x20\p{Lu}", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "local_phone": r"[0-9]{3}[.-][0-9]{4}"}
CUES = {
    "email": "mail|contact|write|schreib|contacter|correo", "ip": "ip|host|server|address|adresse", "card": "card|visa|master|amex|karte|carte|tarjeta|credit|payment",
    "phone": "phone|tel|call|mobile|fax|ruf|appel|llam", "ssn": "ssn|social|security", "iban": "iban|account|konto|compte|cuenta", "secret": "token|key|secret|password|passwd|pwd|auth|bearer",
    "name": "name|contact|dear|signed|von|by", "local_phone": "phone|tel|call|mobile|fax|ruf|appel|llam",
}
AGAINST = "isbn|issn|order|invoice|version|build|serial|part no|article|sku|sha|commit|digest|hash|checksum"
LABELERS, CONTEXT, KEEP = 4, 32, 0.5


_FOUND = "array<struct<start: int, end: int, match: string, before: string, around: string>>"


def _found(text: Column, kind: str) -> Column:
    """Array of (start, end, match, before, around) of the leftmost, non-overlapping matches.

    Lengths of matches and of what lies between add up to offsets, and the surroundings of a match are the ends of its
    neighbours, so nothing walks the text again for a match. ``before`` reaches back to the match before at most.
    """
    needs = F.contains(text, F.lit(NEEDS[kind])) if len(NEEDS[kind]) == 1 else text.rlike(NEEDS[kind])
    none = F.expr(f"cast(array() AS {_FOUND})")

    def spans(m: Column, b: Column) -> Column:
        widths = F.transform(m, lambda x, i: F.length(x) + F.length(F.get(b, i)))
        last = lambda i, n: F.right(F.concat(F.right(F.coalesce(F.get(m, i - 1), F.lit("")), F.lit(n)), F.right(F.get(b, i), F.lit(n))), F.lit(n))
        next_ = lambda i: F.left(F.concat(F.left(F.get(b, i + 1), F.lit(1)), F.left(F.coalesce(F.get(m, i + 1), F.lit("")), F.lit(1))), F.lit(1))
        one = lambda x, i, e: F.struct((F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("end"), x.alias("match"), last(i, CONTEXT).alias("before"), F.concat(last(i, 1), F.lit(" "), next_(i)).alias("around"))
        return let(running(widths, lambda p, q: p + q), lambda e: F.transform(m, lambda x, i: one(x, i, e)))

    matches = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    found = let(matches, lambda m: F.when(F.size(m) > 0, let(F.split(text, PATTERNS[kind], -1), lambda b: spans(m, b))).otherwise(none))
    return F.when(needs, found).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    at = lambda i: F.ascii(F.substr(digits, F.length(digits) - i + 1, F.lit(1))) - 48
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, doubled(at(i))).otherwise(at(i)))
    return total % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a match meets the kind's definition."""
    if kind == "secret":
        return m.rlike("[0-9]")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.substr(part(p), F.lit(1), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(_digits(m)).between(12, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _format_vote(kind: str, m: Column) -> Column:
    """1 or 0: the strict format of a kind."""
    d = _digits(m)
    return {
        "email": m.rlike(r"^[A-Za-z0-9][^@]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}$"),
        "ip": m.rlike(r"^(?!0)[0-9.]+$"),
        "card": F.length(d).isin(15, 16),
        "phone": F.length(d).between(10, 13),
        "ssn": ~m.rlike(r"^(?:000|666|9)|-00-|-0000$"),
        "iban": F.length(F.replace(m, F.lit(" "))).between(15, 34),
        "secret": m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~m.rlike(r"(.)\1{4}"),
        "name": m.rlike(r"\p{Ll}{2}"),
        "local_phone": ~m.rlike(r"^\(?[01]"),
    }[kind].cast("int")


def _gazetteer_vote(kind: str, m: Column) -> Column:
    """1 if a list knows it, 2 (abstains) if not."""
    known = {
        "email": m.rlike(r"\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$"),
        "ip": ~m.rlike(r"^(?:0|127|255)\."),
        "card": _digits(m).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"),
        "phone": m.rlike(r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"),
        "iban": m.rlike("^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"),
        "secret": m.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|AKIA|ghp_|sk-|xox)"),
    }.get(kind, F.lit(False))
    return F.when(known, 1).otherwise(2)


def _spans(text: Column, kind: str) -> Column:
    """Candidates of a kind with their votes."""

    def one(s):
        before = F.lower(s["before"])
        cue = F.when(before.rlike(AGAINST), 0).when(before.rlike(CUES[kind]), 1).otherwise(2)
        apart = (~s["around"].rlike(r"[\p{L}\p{N}@/_]")).cast("int")
        votes = F.array(_format_vote(kind, s["match"]), _gazetteer_vote(kind, s["match"]), cue, apart)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind in BASE).alias("base"), votes.alias("votes"))

    return F.transform(F.filter(_found(text, kind), lambda s: valid(kind, s["match"])), one)


def _overlaps(x: Column, base: Column) -> Column:
    """Whether a span overlaps one of sorted spans that don't overlap each other: of those that begin before its end the last one decides."""
    middle = lambda r: ((r["lo"] + r["hi"]) / 2).cast("int")
    pair = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def halve(r: Column, _: Column) -> Column:
        before = F.get(base, middle(r))["start"] < x["end"]
        return F.when(r["lo"] >= r["hi"], r).otherwise(pair(F.when(before, middle(r) + 1).otherwise(r["lo"]), F.when(before, r["hi"]).otherwise(middle(r))))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(base) + F.lit(1))).cast("int"))
    first_after = F.aggregate(steps, pair(F.lit(0), F.size(base)), halve)["lo"]
    return F.coalesce(F.get(base, first_after - 1)["end"] > x["start"], F.lit(False))


def candidates(documents: DataFrame, keep: tuple = ()) -> DataFrame:
    """doc_id, spans (kind, start, end, base, votes) and the columns of ``keep``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select("doc_id", *keep, text.alias("_text"))
    rows = rows.withColumns({f"_base_{k}": _spans(F.col("_text"), k) for k in BASE})
    added = F.concat(*(_spans(F.col("_text"), k) for k in ADDED))
    clash = lambda x: F.coalesce(*(F.when(_overlaps(x, F.col(f"_base_{k}")), True) for k in BASE), F.lit(False))
    return rows.select("doc_id", *keep, F.concat(*(F.col(f"_base_{k}") for k in BASE), F.filter(added, lambda x: ~clash(x))).alias("spans"))


_PRODUCT = "aggregate(sequence(0, {m} - 1), cast(1.0 AS double), (a, j) -> a * s.theta[{y}][j * 3 + p.votes[j]])"


def _em(rounds: int) -> str:
    """SQL: patterns with their posterior q, from the column ``patterns`` (kind, votes, n)."""
    one, zero = (_PRODUCT.format(m=LABELERS, y=y) for y in (1, 0))
    posterior = f"transform(patterns, p -> named_struct('kind', p.kind, 'votes', p.votes, 'n', p.n, 'q', transform(array(named_struct('a', s.prior * {one}, 'b', (1 - s.prior) * {zero})), r -> r.a / (r.a + r.b))[0]))"
    mass = {1: "x.n * x.q", 0: "x.n * (1 - x.q)"}
    theta = ", ".join(f"transform(sequence(0, {3 * LABELERS - 1}), c -> (1 + aggregate(e, cast(0 AS double), (a, x) -> a + IF(x.votes[c div 3] = c % 3, {mass[y]}, 0))) / (3 + aggregate(e, cast(0 AS double), (a, x) -> a + {mass[y]})))" for y in (0, 1))
    prior = "(1 + aggregate(e, cast(0 AS double), (a, x) -> a + x.n * x.q)) / (2 + aggregate(e, cast(0 AS double), (a, x) -> a + x.n))"
    update = f"transform(array({posterior}), e -> named_struct('prior', {prior}, 'theta', array({theta})))[0]"
    # a vote for counts as better evidence of personal data to begin with
    begin = {0: "0.5D, 0.2D, 0.3D", 1: "0.2D, 0.5D, 0.3D"}
    start = f"named_struct('prior', 0.5D, 'theta', array(array({', '.join([begin[0]] * LABELERS)}), array({', '.join([begin[1]] * LABELERS)})))"
    model = f"aggregate(sequence(1, {rounds}), {start}, (s, i) -> {update})"
    return f"transform(array({model}), s -> {posterior})[0]"


_FEATURES = f"concat(array(1.0D), transform(sequence(0, {len(KINDS) - 1}), k -> IF(x.kind = element_at(array({', '.join(repr(k) for k in KINDS)}), k + 1), 1.0D, 0.0D)), flatten(transform(x.votes, v -> array(IF(v = 0, 1.0D, 0.0D), IF(v = 1, 1.0D, 0.0D)))))"


def _logistic(rounds: int, rate: float, ridge: float) -> str:
    """SQL: classifier weights from the column ``labelled`` (f, n, q), by gradient steps."""
    n = 1 + len(KINDS) + 2 * LABELERS
    p = "1 / (1 + exp(-aggregate(zip_with(x.f, w, (a, b) -> a * b), cast(0 AS double), (a, b) -> a + b)))"
    errors = f"transform(labelled, x -> named_struct('f', x.f, 'g', x.n * (x.q - {p})))"
    total = "aggregate(labelled, cast(0 AS double), (a, x) -> a + x.n)"
    step = f"transform(array({errors}), e -> transform(w, (v, j) -> v + {rate}D * (aggregate(e, cast(0 AS double), (a, x) -> a + x.g * x.f[j]) / {total} - {ridge}D * v)))[0]"
    return f"aggregate(sequence(1, {rounds}), array_repeat(cast(0 AS double), {n}), (w, i) -> {step})"


def train(found: DataFrame, em_rounds: int = 12, rounds: int = 60, rate: float = 2.0, ridge: float = 0.001) -> list[float]:
    """Weights of the span classifier, from the counted vote patterns of ``candidates``."""
    counts = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").agg(F.count("*").cast("double").alias("n"))
    row = counts.agg(F.array_sort(F.collect_list(F.struct("kind", "votes", "n"))).alias("patterns")).filter(F.size("patterns") > 0)
    row = row.select(F.expr(_em(em_rounds)).alias("posterior"))
    row = row.select(F.expr(f"transform(posterior, x -> named_struct('f', {_FEATURES}, 'n', x.n, 'q', x.q))").alias("labelled"))
    out = row.select(F.expr(_logistic(rounds, rate, ridge)).alias("w")).first()
    return list(out["w"]) if out else [-1.0] + [0.0] * (len(KINDS) + 2 * LABELERS)


def decide(found: DataFrame, weights: list[float], keep: float = KEEP) -> DataFrame:
    """The spans that stay: all base ones, and those the classifier gives at least ``keep``; in order of start, then kind."""
    w = f"array({', '.join(f'{x!r}D' for x in weights)})"
    p = f"1 / (1 + exp(-aggregate(zip_with({_FEATURES}, {w}, (a, b) -> a * b), cast(0 AS double), (a, b) -> a + b)))"
    kept = F.expr(f"filter(spans, x -> x.base OR {p} >= {keep})")
    place = f"array_position(array({', '.join(repr(k) for k in KINDS)}), x.kind)"
    ordered = F.expr(f"array_sort(transform(kept, x -> named_struct('start', x.start, 'place', {place}, 'end', x.end, 'kind', x.kind, 'base', x.base)))")
    return found.withColumn("kept", kept).withColumn("spans", ordered).drop("kept")


def report(found: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans as text."""
    shown = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(shown(F.filter("spans", lambda x: x["base"])), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def with_rows(documents: DataFrame) -> DataFrame:
    """``candidates`` with the rows they were found in, for ``redact``."""
    return candidates(documents.withColumn("_row", F.struct(*documents.columns)), keep=("_row",))


def redact(found: DataFrame, weights: list[float]) -> DataFrame:
    """The rows of ``with_rows`` with each span replaced by its kind in brackets, overlapping spans by the first one's."""
    names = found.schema["_row"].dataType.names
    text = F.col("_row.text")
    found = decide(found, weights)

    def cut(own: Column, ends: Column) -> Column:
        # how far the spans before reach
        reach = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        shown = F.transform("spans", lambda x, i: F.when(x["start"] >= reach(i), F.concat(piece(own, reach(i), x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(""))
        return F.concat(F.array_join(shown, ""), piece(own, F.element_at(ends, -1), F.length(text)))

    ends = running(F.transform("spans", lambda x: x["end"]), F.greatest)
    out = F.when(F.size("spans") > 0, let(cells(text), lambda c: let(ends, lambda e: cut(c, e)))).otherwise(text)
    return found.select(*(out.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in names))


def find(documents: DataFrame) -> DataFrame:
    """doc_id and the spans that stay; candidates are kept as a table between counting and deciding."""
    found = materialize(candidates(documents), "candidates")
    return decide(found, train(found))
