"""Personal data by weak supervision, in DataFrame functions only.

Base spans are what strict patterns and checks find. The method adds looser candidates: labelers
(shape, gazetteer, context, edges) vote on every candidate, expectation-maximisation estimates how
reliable each labeler is for each kind, and a logistic regression trained on the resulting
probabilities decides about spans. Spark counts the vote patterns; there are at most a few hundred
distinct ones, whatever the corpus, and only their counts come to the driver.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of base spans, written so that Java's engine scans runs once and doesn't recurse.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser candidates: obfuscated addresses, hexadecimal addresses, cards with other separators, numbers without a plus.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[] ?(?:at|AT) ?[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[] ?(?:dot|DOT) ?[)\]]|\.) ?[A-Za-z0-9-]{2,63}){1,4}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){2}[._/][0-9]{2,4}(?![0-9])",
    "phone": r"(?<![0-9+.,-])(?:\([0-9]{3}\) ?|00[1-9][0-9]{0,2}[ -]|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{3,4}(?![0-9])",
}
#: A text without this has no match of the kind.
NEEDS = {"email": "[@(\\[]", "ip": "[0-9a-fA-F][.:][0-9a-fA-F]", "card": "[0-9]", "phone": "[+0][0-9]|[0-9]"}
#: Fixed word lists of the gazetteer and context labelers.
TOP_DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|ai|co|me|eu|uk|us|de|fr|es|it|nl|be|ch|at|pt|pl|se|no|dk|fi|ie|ca|au|nz|jp|cn|in|br|mx|ar|za|ru"
CALLING_CODE = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|3[578]|42|5[09]|6[789]|8[0578]|9[679])[0-9])"
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[04-9]|6(?:011|4|5))"
NEAR = {
    "email": "mail|contact|write|reach|kontakt|schreib|correo|courriel",
    "ip": r"\bip\b|host|server|address|login|adresse|servidor|serveur",
    "card": "card|visa|credit|paid|pay|karte|carte|tarjeta",
    "phone": "tel|phone|call|fax|mobile|dial|whatsapp|telefon|appel|llam",
}
FAR = r"isbn|issn|version|\bv\.?$|section|chapter|order|invoice|serial|part no|\bref\b|total|price|id ?[:=#]?$"
LABELERS = ("shape", "gazetteer", "context", "edge")
CONTEXT = 40


class Model(NamedTuple):
    """Log-odds of the final classifier: a bias per kind and a weight per (labeler, vote)."""

    bias: dict[str, float]
    weight: dict[tuple[str, int], float]
    reliability: dict[tuple[str, str, int], float]  # P(vote | class) by (kind, labeler, vote) for true spans


def _found(text: str, kind: str, pattern: str) -> str:
    """SQL: the matches of ``pattern`` in ``text`` with start, end, what lies before and after.

    ``split`` gives the texts between the matches that ``regexp_extract_all`` gives; a running
    sum of both lengths (in code points) is where each match starts."""
    none = "CAST(array() AS array<struct<s:int,e:int,m:string,b:string,a:string>>)"
    return f"""CASE WHEN {text} RLIKE r'{NEEDS[kind]}' THEN element_at(transform(
        array(named_struct('h', regexp_extract_all({text}, r'{pattern}', 0), 'g', split({text}, r'{pattern}', -1))),
        z -> aggregate(transform(z.g, (g, i) -> struct(get(z.h, i) AS h, g AS g, get(z.g, i + 1) AS n)), named_struct('at', 0, 'out', {none}),
          (acc, x) -> IF(x.h IS NULL, acc, named_struct('at', acc.at + length(x.g) + length(x.h), 'out', array_append(acc.out,
            named_struct('s', acc.at + length(x.g), 'e', acc.at + length(x.g) + length(x.h), 'm', x.h, 'b', right(x.g, {CONTEXT}), 'a', left(x.n, 1))))),
          acc -> acc.out)), 1) ELSE {none} END"""


_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (t, i) -> t + CASE
    WHEN i % 2 = 1 THEN int(substr(reverse({_DIGITS}), i, 1))
    WHEN int(substr(reverse({_DIGITS}), i, 1)) > 4 THEN 2 * int(substr(reverse({_DIGITS}), i, 1)) - 9
    ELSE 2 * int(substr(reverse({_DIGITS}), i, 1)) END) % 10 = 0"""
#: Checks that a match of a base pattern must pass.
VALID = {
    "email": "true",
    "ip": r"forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND int(concat('0', right(ltrim('0', p), 3))) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
}
#: The shape labeler on looser candidates.
SHAPE = {
    "email": "IF(x.m RLIKE r'(?i)dot|\\.[A-Za-z]{2,}$', 1, 0)",
    "ip": "IF(x.m RLIKE '[0-9]' AND x.m RLIKE '[a-fA-F]', 1, 0)",
    "card": f"IF({VALID['card']}, 1, -1)",
    "phone": f"IF(length({_DIGITS}) BETWEEN 10 AND 15, 1, -1)",
}
GAZETTEER = {
    "email": rf"IF(x.m RLIKE r'(?i)[. )\]](?:{TOP_DOMAINS})$', 1, -1)",
    "ip": r"IF(x.m RLIKE r'^(?:0+|127|255)\.', -1, 1)",
    "card": f"IF({_DIGITS} RLIKE r'{CARD_PREFIX}', 1, -1)",
    "phone": f"IF(ltrim('0', {_DIGITS}) RLIKE r'{CALLING_CODE}', 1, -1)",
}


def _votes(kind: str, base: bool) -> str:
    shape = "1" if base else SHAPE[kind]
    context = f"CASE WHEN lower(x.b) RLIKE r'{NEAR[kind]}' THEN 1 WHEN lower(x.b) RLIKE r'{FAR}' THEN -1 ELSE 0 END"
    edge = "IF(x.a RLIKE '[A-Za-z0-9_=/]' OR x.b RLIKE '[A-Za-z0-9_=/#]$', -1, 1)"
    return f"{shape} AS shape, {GAZETTEER[kind]} AS gazetteer, {context} AS context, {edge} AS edge"


def _spans(text: str, kind: str, base: bool) -> str:
    found = _found(text, kind, (BASE if base else LOOSE)[kind])
    if base:
        found = f"filter({found}, x -> {VALID[kind]})"
    return f"""transform({found}, x -> struct(x.s AS start, {KINDS.index(kind)} AS rank, x.e AS stop, '{kind}' AS kind,
        {str(base).lower()} AS base, {_votes(kind, base)}))"""


def candidates() -> Column:
    """Of the column ``_text``: base spans of all kinds, and looser candidates that overlap none of them, in order."""
    docs = "coalesce(_text, '')"
    base = "concat(" + ", ".join(_spans(docs, k, True) for k in KINDS) + ")"
    loose = "concat(" + ", ".join(_spans(docs, k, False) for k in KINDS) + ")"
    joined = f"aggregate(array_sort({loose}), {base}, (acc, c) -> IF(exists(acc, b -> b.start < c.stop AND c.start < b.stop), acc, array_append(acc, c)))"
    return F.expr(f"array_sort({joined})")


def _with_candidates(docs: DataFrame, keep: list[Column], text_col: str) -> DataFrame:
    return docs.select(*keep, docs[text_col].alias("_text")).withColumn("_found", candidates())


def fit(docs: DataFrame, rounds: int = 50, text_col: str = "text") -> Model:
    """Reliabilities by expectation-maximisation over the counts of vote patterns, then the classifier."""
    votes = _with_candidates(docs, [], text_col).select(F.explode("_found").alias("c")).select("c.kind", *(f"c.{v}" for v in LABELERS))
    cells = [(r.kind, tuple(r[v] for v in LABELERS), r.n) for r in votes.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")).collect()]
    return _train(sorted(cells), rounds)


def _train(cells: list[tuple[str, tuple[int, ...], int]], rounds: int) -> Model:
    # start: the share of positive votes; one weak pseudo-count per answer keeps labelers from certainty
    odds = {(k, v): min(0.95, max(0.05, 0.5 + sum(v) / (2 * len(v)))) for k, v, _ in cells}
    told = {}
    for _ in range(rounds):
        prior, told = {}, {}
        for kind in KINDS:
            own = [(v, n, odds[kind, v]) for k, v, n in cells if k == kind]
            mass = {True: sum(n * p for _, n, p in own) + 1, False: sum(n * (1 - p) for _, n, p in own) + 1}
            prior[kind] = mass[True] / (mass[True] + mass[False])
            for i, name in enumerate(LABELERS):
                for vote in (-1, 0, 1):
                    for true in (True, False):
                        seen = sum(n * (p if true else 1 - p) for v, n, p in own if v[i] == vote)
                        lean = 1.0 + (vote if true else -vote) * 0.5  # labelers are taken for better than chance
                        told[kind, name, vote, true] = (seen + lean) / (mass[true] - 1 + 3.0)
        for kind, v, _ in cells:
            score = math.log(prior[kind] / (1 - prior[kind]))
            for name, vote in zip(LABELERS, v, strict=True):
                score += math.log(told[kind, name, vote, True] / told[kind, name, vote, False])
            odds[kind, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))
    bias, weight = dict.fromkeys(KINDS, 0.0), {(name, vote): 0.0 for name in LABELERS for vote in (-1, 0, 1)}
    total = max(1, sum(n for *_, n in cells))
    for _ in range(500):  # logistic regression on soft labels, gradient steps with a small penalty
        down_bias, down = dict.fromkeys(KINDS, 0.0), dict.fromkeys(weight, 0.0)
        for kind, v, n in cells:
            z = bias[kind] + sum(weight[x] for x in zip(LABELERS, v, strict=True))
            off = n / total * (1 / (1 + math.exp(-z)) - odds[kind, v])
            down_bias[kind] += off
            for x in zip(LABELERS, v, strict=True):
                down[x] += off
        for k in bias:
            bias[k] -= 1.0 * (down_bias[k] + 1e-4 * bias[k])
        for x in weight:
            weight[x] -= 1.0 * (down[x] + 1e-4 * weight[x])
    return Model(bias, weight, {(k, n, v): p for (k, n, v, true), p in told.items() if true})


def _accepted(model: Model) -> str:
    """SQL on a candidate ``c``: base spans, and others that the classifier takes."""
    bias = " ".join(f"WHEN '{k}' THEN {b!r}D" for k, b in model.bias.items())
    votes = " + ".join(
        f"CASE c.{name} " + " ".join(f"WHEN {v} THEN {model.weight[name, v]!r}D" for v in (-1, 0, 1)) + " END" for name in LABELERS
    )
    return f"c.base OR (c.shape > 0 AND CASE c.kind {bias} END + {votes} > 0D)"


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, found``: the accepted spans of every row, ``array<struct<start, rank, stop, kind, base, ...>>``
    by start, then kind; code points, end exclusive. The model is fitted on ``docs`` if none is given.

    A null or empty text has no spans. Repeated rows and null ids are treated row by row. An
    empty table gives no rows (and a model that adds nothing). Other columns are not read.
    """
    model = model or fit(docs, text_col=text_col)
    rows = _with_candidates(docs, [docs[id_col].alias(id_col)], text_col)
    return rows.select(id_col, F.expr(f"filter(_found, c -> {_accepted(model)})").alias("found"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, the hash of the base spans, and all spans as text."""
    listed = "array_join(transform({0}, c -> concat_ws(':', c.kind, c.start, c.stop)), ',')"
    return found.select(
        id_col, *(F.expr(f"CAST(size(filter(found, c -> c.base AND c.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.expr(listed.format("filter(found, c -> c.base)")), 256).alias("base_sha256"), F.expr(listed.format("found")).alias("spans"),
    )


def redact(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every accepted span replaced by its kind in brackets; overlapping spans become one."""
    model = model or fit(docs, text_col=text_col)
    rows = docs.select(F.struct(*[docs[c].alias(f"c{n}") for n, c in enumerate(docs.columns)]).alias("row"), docs[text_col].alias("_text"))
    rows = rows.withColumn("_found", candidates()).withColumn("_taken", F.expr(f"filter(_found, c -> {_accepted(model)})"))
    clean = F.expr("""CASE WHEN size(_taken) = 0 THEN _text ELSE aggregate(
        _taken, named_struct('at', 0, 'out', '', 'text', _text),
        (acc, c) -> named_struct('at', greatest(acc.at, c.stop), 'out',
          IF(c.start >= acc.at, concat(acc.out, substr(acc.text, acc.at + 1, c.start - acc.at), '[', upper(c.kind), ']'), acc.out), 'text', acc.text),
        acc -> concat(acc.out, substr(acc.text, acc.at + 1))) END""")
    return rows.select(*(clean.alias(c) if c == text_col else F.col(f"row.c{n}").alias(c) for n, c in enumerate(docs.columns)))
