"""Statements in dialogue: what a user asks to keep, assertions, what confirms and what contradicts, grounding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import patterns as P

NEGATIVE = frozenset([*P.POLARITY, "cannot", "can't", "doesn't", "isn't", "won't", "don't", "didn't", "wasn't"])
OPPOSITE = {"enabled": "disabled", "on": "off", "true": "false", "allowed": "forbidden", "up": "down", "open": "closed", "включен": "выключен", "истина": "ложь"}


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", (text or "").casefold())


def kept_statements(role: str, text: str) -> list[tuple[str, str, int]]:
    """(kind, statement, start) of a user's turn: preferences before decisions, facts and requests; none overlaps an earlier one, none is quoted."""
    if role != "user":
        return []
    quoted = [m.span() for m in re.finditer(P.QUOTED, text or "")]
    taken: list[tuple[int, int]] = []
    out = []
    for kind, pattern in P.KEPT.items():
        for m in re.finditer(pattern, text or "", re.I):
            a, b = m.span()
            if any(x < b and a < y for x, y in taken) or any(x <= a and b <= y for x, y in quoted):
                continue
            statement = m.group(1).strip()
            if len(statement) >= 3:
                taken.append((a, b))
                out.append((kind, statement, a))
    return sorted(out, key=lambda x: x[2])


def extracted(turns: DataFrame, keys: list[str], role: str = "role", text: str = "text") -> DataFrame:
    """keys, kind, statement, start for every statement worth keeping."""
    kinds = dict(turns.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [[*(getattr(r, k) for k in keys), *s] for r in f.itertuples(index=False) for s in kept_statements(getattr(r, role), getattr(r, text) or "")]
            yield pd.DataFrame(rows, columns=[*keys, "kind", "statement", "start"])

    return turns.select(*dict.fromkeys([*keys, role, text])).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", kind string, statement string, start int")


def deduplicated(statements: DataFrame, session: str, text: str, score: str) -> DataFrame:
    """Statements of a session less those that repeat a better one: equal, or contained for 80 % with a Jaccard similarity of 60 %."""
    kinds = dict(statements.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        done: list = []
        for _, row in frame.sort_values([score, text], ascending=[False, True]).iterrows():
            w = set(words(row[text]))
            for _, v in done:
                common = len(w & v)
                if w == v or (common >= 0.8 * min(len(w), len(v)) and common >= 0.6 * len(w | v)):
                    break
            else:
                done.append((row, w))
        return pd.DataFrame([r for r, _ in done], columns=frame.columns)

    return statements.groupBy(session).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in statements.columns))


def assertion(text: str) -> tuple[tuple[str, ...], bool]:
    """The words of a statement that carry it, articles and negations aside, and whether it is affirmed."""
    w = words(text)
    affirmed = sum(x in NEGATIVE and x not in OPPOSITE.values() for x in w) % 2 == 0
    out = []
    for x in w:
        for yes, no in OPPOSITE.items():
            if x == no:
                affirmed, x = not affirmed, yes
        if x not in P.SOFT_WORDS and x not in NEGATIVE and x not in ("do", "does", "did"):
            out.append(x)
    return tuple(out), affirmed


def compared(old: str, new: str) -> str:
    """confirms, contradicts or novel: the same words in order affirm or deny one another; swapped roles are novel."""
    (a, yes), (b, too) = assertion(old), assertion(new)
    if a == b and a:
        return "confirms" if yes == too else "contradicts"
    if len(a) == len(b) > 2 and sum(x != y for x, y in zip(a, b, strict=True)) == 1:
        x, y = next((x, y) for x, y in zip(a, b, strict=True) if x != y)
        if x.isdigit() and y.isdigit():
            return "contradicts"
    return "novel"


def grounded(statement: str, source: str, least: float = 0.72) -> bool:
    """Whether a source supports a statement: enough of its words by their first five letters and in order, all its numbers, the same polarity."""
    w, s = words(statement), words(source)
    if not w:
        return False
    hard = [x for x in w if any(c.isdigit() for c in x)]
    if any(x not in s for x in hard) or (sum(x in NEGATIVE for x in w) % 2) != (sum(x in NEGATIVE for x in s) % 2):
        return False
    heads, at, found = [x[:5] for x in s], 0, 0
    for x in w:
        if x[:5] in heads[at:]:
            at = heads.index(x[:5], at) + 1
            found += 1
    return found / len(w) >= least


def with_verdict(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """pairs with verdict (compared) and supported (new grounded in old)."""
    verdict = F.pandas_udf(lambda a, b: pd.Series([compared(x or "", y or "") for x, y in zip(a, b, strict=True)]), "string")
    supported = F.pandas_udf(lambda a, b: pd.Series([grounded(y or "", x or "") for x, y in zip(a, b, strict=True)]), "boolean")
    return pairs.withColumn("verdict", verdict(old, new)).withColumn("supported", supported(old, new))


# Cues of relations, by predicate.
RELATION_CUES = {
    "uses": r"\b(?:uses?|using|использует)\b", "depends_on": r"\b(?:depends? on|requires?|зависит от|требует)\b", "part_of": r"\b(?:part of|belongs to|часть|входит в)\b",
    "owns": r"\b(?:owns?|владеет)\b", "works_on": r"\b(?:works? on|работает над)\b", "located_in": r"\b(?:located in|lives? in|находится в|живет в)\b",
    "created": r"\b(?:created|wrote|built|создал|написал)\b", "prefers": r"\b(?:prefers?|предпочитает)\b", "knows": r"\b(?:knows?|знает)\b",
}


def grounded_relation(text: str, subject: str, predicate: str, obj: str) -> bool:
    """Whether one clause says subject, cue of the predicate and object in this order, without a negation."""
    cue = RELATION_CUES.get(predicate)
    if not cue:
        return False
    for clause in re.split(r"[.!?;\n]+|,\s+(?:and|but|и|но)\s+", text or ""):
        low = clause.casefold()
        a, b = low.find(subject.casefold()), low.rfind(obj.casefold())
        m = re.search(cue, low)
        if m and 0 <= a < m.start() and m.end() <= b and not NEGATIVE.intersection(words(low[a:b])):
            return True
    return False
