"""Lexical retrieval: tokens, BM25 over whole-table statistics, conjunctive then disjunctive passes, literal fallback.

A query has few terms, so scoring needs no postings shuffle: one aggregation over the scan gives the statistics of the
terms, and the second scan scores each row where it lies and keeps the top rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{Nd}_]+"
K1, B = 1.2, 0.75


def tokens(text: Column | str, pattern: str = WORD) -> Column:
    """Lower-case words in order."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


#: Combining marks that are dropped where diacritics are.
MARKS = "\u0300-\u036f"


@lru_cache(maxsize=1)
def bare_letters() -> dict[str, str]:
    """Letters below U+2000 with diacritics, to the letter that is left when Unicode's decomposition loses its marks."""
    found = {}
    for c in map(chr, range(0xC0, 0x2000)):
        rest = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(rest) == 1 and rest != c:
            found[c] = rest
    return found


@dataclass(frozen=True)
class Analyzer:
    """How a table's texts are cut into terms: lower-case runs of letters, marks, digits, _ and ``signs``; ``folds`` drops diacritics.

    ``tokens`` does it for a column by the JVM's functions, ``cut`` for a question on the driver.
    """

    name: str
    signs: str = ""
    folds: bool = False

    @property
    def pattern(self) -> str:
        return WORD[:-2] + re.escape(self.signs) + "]+"

    def tokens(self, text: Column | str) -> Column:
        text = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
        if self.folds:
            bare = bare_letters()
            text = F.regexp_replace(F.translate(text, "".join(bare), "".join(bare.values())), f"[{MARKS}]", "")
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def cut(self, text: str) -> list[str]:
        text = text.lower()
        if self.folds:
            text = re.sub(f"[{MARKS}]", "", text.translate(str.maketrans(bare_letters())))
        inside = lambda c: c == "_" or c in self.signs or unicodedata.category(c)[0] in "LM" or unicodedata.category(c) == "Nd"
        return "".join(c if inside(c) else " " for c in text).split(" ") if not text.isspace() else []

    def terms(self, words: list[str]) -> list[str]:
        """The terms that words of a question are cut into, each once."""
        return list(dict.fromkeys(t for w in words for t in self.cut(w) if t))


#: Events, claims and dialogue; code and paths; documents.
WORDS, CODE, FOLDED = Analyzer("words"), Analyzer("code", "./:@#$-"), Analyzer("folded", folds=True)


def event_terms(query: str) -> list[str]:
    """Up to 12 words of a query, in order, each once."""
    return list(dict.fromkeys(re.findall(r"\w+", query.lower())))[:12]


def graph_terms(query: str, most: int = 16) -> list[str]:
    """Words for code (16) or documents (20): stripped of outer punctuation, two letters at least, case-insensitively once."""
    found: dict[str, str] = {}
    for word in re.findall(r"[\w./:@#$+-]+", query):
        word = word.strip("./:@#$+-_")
        if len(word) >= 2:
            found.setdefault(word.casefold(), word)
    return [w.lower() for w in list(found.values())[:most]]


def postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, length): an inverted index for tables that many queries read."""
    own = rows.select(key, tokens(text).alias("_t"))
    return own.select(key, F.size("_t").alias("length"), F.explode("_t").alias("term")).groupBy("term", key, "length").agg(F.count("*").alias("tf")).select("term", key, "tf", "length")


def _idf(n: int, df: int) -> float:
    """Floored at 1e-6 for terms of most rows."""
    return max(1e-6, math.log((n - df + 0.5) / (df + 0.5)))


def _counted(rows: DataFrame, text: str, terms: list[str], analyzer: Analyzer = WORDS) -> tuple[DataFrame, int, float, list[int]]:
    """rows with _n (words) and _f (occurrences of each term), and the table's row count, mean length and document frequencies."""
    tf = [F.size(F.filter("_t", _is(t))) for t in terms]
    counted = rows.withColumn("_t", analyzer.tokens(text)).withColumn("_n", F.size("_t"))
    counted = counted.withColumn("_t", F.filter("_t", lambda x: x.isin(*terms))).withColumn("_f", F.array(*tf) if tf else F.array().cast("array<int>")).drop("_t")
    aggs = [F.sum((F.get("_f", F.lit(i)) > 0).cast("long")) for i in range(len(terms))]
    n, length, *df = counted.agg(F.count("*"), F.avg("_n"), *aggs).first()
    return counted, n, float(length or 1), [x or 0 for x in df]


def _scored(terms: list[str], among: list[str], n: int, length: float, df: list[int]) -> tuple[Column, Column]:
    score, matched = F.lit(0.0), F.lit(0)
    for t in terms:
        i = among.index(t)
        f = F.get("_f", F.lit(i))
        score = score + F.lit(_idf(n, df[i])) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_n") / F.lit(length)))
        matched = matched + (f > 0).cast("int")
    return score, matched


def _exploded(counted: DataFrame, hits: Column, columns: list[str]) -> DataFrame:
    """A row for each hit. A plain filter would be pushed below the tokens and split every text twice."""
    return counted.withColumn("_s", F.explode_outer(hits)).where("_s is not null").select(*columns, "_s.*")


def bm25(rows: DataFrame, key: str, text: str, terms: list[str], every: bool = False) -> DataFrame:
    """rows with score (larger is better) and matched (terms found), for rows with any of the terms, or with every one.

    Statistics are those of all rows given; apply visibility afterwards to keep them whole-table.
    """
    terms = list(dict.fromkeys(terms))
    counted, n, length, df = _counted(rows, text, terms)
    score, matched = _scored(terms, terms, n, length, df)
    least = len(terms) if every else 1
    hit = F.struct(score.alias("score"), matched.alias("matched"))
    return _exploded(counted, F.filter(F.array(hit), lambda x: x["matched"] >= max(1, least)), rows.columns)


def bm25_many(rows: DataFrame, key: str, text: str, queries: list[list[str]], n: int, analyzer: Analyzer = WORDS) -> DataFrame:
    """The n best rows of each of several queries: rows with query (its number), score, matched, rank; ties by key.

    All queries share the two scans, and only n rows of each query and task reach the shuffle.
    """
    queries = [list(dict.fromkeys(q)) for q in queries]
    terms = list(dict.fromkeys(t for q in queries for t in q))
    counted, total, length, df = _counted(rows, text, terms, analyzer)
    each = []
    for i, q in enumerate(queries):
        score, matched = _scored(q, terms, total, length, df)
        each.append(F.struct(F.lit(i).alias("query"), score.alias("score"), matched.alias("matched")))
    hits = _exploded(counted, F.filter(F.array(*each), lambda x: x["matched"] > 0), rows.columns)
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _is(term: str):
    return lambda x: x == term


def top(scored: DataFrame, n: int, *ties: Column) -> DataFrame:
    """The n best rows; ties by the columns given."""
    return scored.orderBy(F.desc("score"), *ties).limit(n)


def two_pass(rows: DataFrame, key: str, text: str, terms: list[str], n: int, *ties: Column) -> DataFrame:
    """Rows with all terms, best first, then rows with any, each once: key, pass_no, position, score.

    Both passes are always taken in full before they are cut, so hits of the first that a later guard rejects don't starve
    the result.
    """
    return two_pass_scored(bm25(rows, key, text, terms), key, terms, n, *ties)


def two_pass_scored(scored: DataFrame, key: str, terms: list[str], n: int, *ties: Column) -> DataFrame:
    """The same over scored rows, which a reader's predicate may have narrowed since: statistics stay those of the whole table."""
    first = scored.where(F.col("matched") == len(set(terms))).withColumn("pass_no", F.lit(1))
    both = top(first, n, *ties).unionByName(top(scored.withColumn("pass_no", F.lit(2)), n, *ties))
    once = both.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("pass_no"))).where("_r = 1").drop("_r")
    order = Window.orderBy("pass_no", F.desc("score"), *ties)  # 2n rows at most
    return once.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def literal_fallback(rows: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Rows that contain the first term of three letters or more, ASCII case aside; for queries that the index can't answer."""
    term = next((t for t in terms if len(t) >= 3), None)
    return rows.where(F.lit(False)) if term is None else rows.where(F.contains(F.lower(F.col(text)), F.lit(term.lower())))


def newest(rows: DataFrame, n: int, moment: str, key: str) -> DataFrame:
    return rows.orderBy(F.desc(moment), key).limit(n)


def page_after(rows: DataFrame, moment: str, key: str, last: tuple | None, n: int) -> DataFrame:
    """Keyset pages, newest first, null moments last, ties by key; last: (moment, key) of the page before."""
    if last is not None:
        after = F.col(moment).isNull() & (F.col(key) > F.lit(last[1])) if last[0] is None else (
            (F.col(moment) < F.lit(last[0])) | F.col(moment).isNull() | ((F.col(moment) == F.lit(last[0])) & (F.col(key) > F.lit(last[1])))
        )
        rows = rows.where(after)
    return rows.orderBy(F.desc_nulls_last(moment), key).limit(n)
