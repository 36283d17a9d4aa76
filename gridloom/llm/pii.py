"""Personal data: expressions propose spans, checksums confirm them, context adjusts the score.

Everything here is Spark SQL functions; no Python runs on the executors.

A kind's expression yields its matches from left to right without overlap, as
`regexp_extract_all` finds them; `split` by the same expression yields the pieces
between them, so a span's place is a running sum of lengths in code points and its
context is the neighbouring pieces. Validators then drop matches: octets for
addresses, Luhn for cards, digit counts for phones, mod-97 for IBANs. Kinds beyond
the four base ones (IBAN, US social security number, secret token) are reported only
when checksum and context words lift their score to THRESHOLD.

Defined results: null text counts as empty and has no span; an empty table gives an
empty table; repeated rows are reported once each; other columns of the input are
ignored, whatever their names. Very long texts are searched whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A span of an added kind needs this score.
THRESHOLD = 0.5
#: Characters of context on either side.
CONTEXT = 40


@dataclass(frozen=True)
class Kind:
    name: str
    #: Linear in the text: possessive quantifiers, and starts only where a run of the first class begins.
    pattern: str
    #: A cheap test that any text with a match passes: a literal, or an expression that begins with a class.
    hint: str
    base: bool
    score: float
    boost: float
    words: str


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.9, 0.1, "mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", True, 0.6, 0.3, r"\bip\b|host|server|address|login|adresse"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", True, 0.8, 0.2, "card|visa|credit|payment|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True, 0.7, 0.2, "phone|call|tel|mobile|fax|whatsapp"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", "[0-9]{2}", False, 0.8, 0.2, "iban|bank|account|konto|cuenta|compte"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", False, 0.3, 0.5, r"\bssn\b|social security"),
    Kind("secret", r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+", "[A-Za-z0-9_/+-]{20}", False, 0.2, 0.6, r"\b(?:api[_ -]?key|secret|token|passwo?r?d|bearer)\b[\"']?\s*[:=]?\s*[\"']?$"),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _small_cumsum(a: Column) -> Column:
    first = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("sum"))
    step = lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["sum"] + x)).alias("out"), (acc["sum"] + x).alias("sum"))
    return F.aggregate(a, first, step, lambda acc: acc["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 20 digits passes the Luhn check."""
    d = F.lpad(digits, 20, "0")
    doubled = F.translate(d, "0123456789", "0246813579")
    parts = [F.substring(d if i % 2 == 0 else doubled, i, 1).cast("int") for i in range(1, 21)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without spaces passes the mod-97 check."""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    step = lambda acc, c: F.when(c.rlike("^[0-9]$"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^(?:(?:0++|0*+(?:[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5]))(?:\.|$)){4}$")
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return mod97(F.replace(m, F.lit(" "), F.lit("")))
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


def _score(k: Kind, before: Column, after: Column) -> Column:
    near = F.lower(F.right(before, F.lit(CONTEXT)))
    if k.name == "secret":  # what introduces a secret stands right before it
        hit = near.rlike(k.words)
    else:
        hit = near.rlike(k.words) | F.lower(F.left(after, F.lit(CONTEXT))).rlike(k.words)
    return F.when(hit, F.lit(k.score + k.boost)).otherwise(F.lit(k.score))


_SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double,match:string>"
#: Running sums go by blocks of this many matches: a text with very many stays far below quadratic cost.
_BLOCK = 128


def _with(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """All columns of one step at once, so that the plan grows with the steps and not with steps times kinds."""
    return df.withColumns(made)


def _spans(df: DataFrame) -> DataFrame:
    """Adds `spans`: array of (start, rank, end, kind, score, match), base kinds all, others by score.

    df has a `text` that is never null."""
    text, every = F.col("text"), list(enumerate(KINDS))
    hint = lambda k: text.rlike(k.hint) if k.hint.startswith("[") else text.contains(k.hint)
    df = _with(df, {f"_m{r}": F.when(hint(k), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))) for r, k in every})
    df = _with(df, {f"_p{r}": F.when(F.size(f"_m{r}") > 0, F.split(text, k.pattern, -1)) for r, k in every})

    def steps(r: int) -> Column:
        return F.transform(f"_m{r}", lambda x, i: F.length(x) + F.length(F.get(F.col(f"_p{r}"), i)))

    df = _with(df, {f"_l{r}": F.when(F.col(f"_p{r}").isNotNull(), steps(r)) for r, _ in every})

    def blocks(r: int) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(f"_l{r}") - 1) / _BLOCK).cast("int")), lambda b: _small_cumsum(F.slice(F.col(f"_l{r}"), b * _BLOCK + 1, _BLOCK)))
        return F.when(F.size(f"_l{r}") > 0, cut)

    df = _with(df, {f"_b{r}": blocks(r) for r, _ in every})
    df = _with(df, {f"_o{r}": _small_cumsum(F.transform(f"_b{r}", lambda x: F.element_at(x, -1))) for r, _ in every})

    def ends(r: int) -> Column:
        return F.flatten(F.transform(f"_b{r}", lambda x, i: F.transform(x, lambda v: v + F.when(i > 0, F.get(F.col(f"_o{r}"), i - 1)).otherwise(0))))

    df = _with(df, {f"_e{r}": ends(r) for r, _ in every})

    def made(r: int, k: Kind) -> Column:
        end = lambda i: F.get(F.col(f"_e{r}"), i)
        span = lambda x, i: F.struct(
            (end(i) - F.length(x)).alias("start"), F.lit(r).alias("rank"), end(i).alias("end"), F.lit(k.name).alias("kind"),
            _score(k, F.get(F.col(f"_p{r}"), i), F.get(F.col(f"_p{r}"), i + 1)).alias("score"), x.alias("match"),
        )
        keep = lambda s: _valid(k.name, s["match"]) & (F.lit(True) if k.base else s["score"] >= THRESHOLD)
        return F.coalesce(F.when(F.col(f"_e{r}").isNotNull(), F.filter(F.transform(f"_m{r}", span), keep)), F.array().cast(f"array<{_SPAN}>"))

    df = _with(df, {f"_k{r}": made(r, k) for r, k in every})
    df = df.withColumn("spans", F.array_sort(F.concat(*[F.col(f"_k{r}") for r, _ in every])))
    return df.drop(*[f"_{x}{r}" for r, _ in every for x in "mplboek"])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text, and `spans`: array<struct<start,rank,end,kind,score,match>> ordered by start, then kind."""
    return _spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return find(docs).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; all columns stay as they are but text.

    Overlapping spans become one, named after the first."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = F.struct(*[F.col(f"`{c}`") for c in others]).alias("_rest") if others else F.lit(None).alias("_rest")
    df = docs.select("doc_id", "text", kept)
    df = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("_null"), "_rest")
    df = _spans(df)
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def join(acc, s):
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        new = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        return F.when(F.size(acc) == 0, F.array(new)).when(s["start"] < last["end"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(new)))

    df = df.withColumn("_merged", F.when(F.size("spans") > 0, F.aggregate("spans", empty, join)))
    before = lambda i: F.when(i > 0, F.get(F.col("_merged"), i - 1)["end"]).otherwise(0)
    cut = F.transform("_merged", lambda s, i: F.concat(F.substr(F.col("text"), before(i) + 1, s["start"] - before(i)), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    tail = F.substr(F.col("text"), F.element_at("_merged", -1)["end"] + 1)
    text = F.when(F.col("_null"), F.lit(None)).when(F.col("_merged").isNull(), F.col("text")).otherwise(F.concat(F.array_join(cut, ""), tail))
    df = df.withColumn("text", text)
    return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_rest")[c].alias(c) for c in docs.columns])
