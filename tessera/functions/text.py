"""Text as columns: redaction, guards, excerpts, identifiers, small scalars."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import patterns as P
from tessera.operators.observe import folded


#: Literals of which every secret holds one, and parts of words of which every label holds one in lower case (or a long s, which
#: folds to s); cheap to look for.
_KEYS = ("sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "AKIA", "ASIA", "AIza", "xox", "eyJ")
_LABELS = ("assw", "asscode", "pwd", "key", "secret", "token", "authoriz", "арол", "код", "ключ", "токен", "секрет", "авториз", "ſ")


def _hinted(text: Column) -> Column:
    """Whether a text may hold a secret: literals, and parts of labels in lower case, are looked for without a pattern."""
    hit = F.contains(text, F.lit("://")) & F.contains(text, F.lit("@"))
    for key in _KEYS:
        hit = hit | F.contains(text, F.lit(key))
    low = F.array(F.lower(text))  # once, for all that is looked for in it
    return hit | F.exists(low, lambda t: _any(t, ("-----begin", *_LABELS)))


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | F.contains(text, F.lit(part))
    return hit


def redacted(text: Column, limit: int | None = None) -> Column:
    """Secrets replaced, in this order: private keys, credentials in URLs, labelled values, provider tokens. Then line ends trimmed.

    Texts without a literal that secrets begin with are spared the patterns. limit cuts the result, if one is given.
    """
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\x00", ""), "\r\n?", "\n")
    t = F.regexp_replace(plain, P.PRIVATE_KEY, "<REDACTED_PRIVATE_KEY>")
    t = F.regexp_replace(t, P.URL_CREDENTIALS, "$1<REDACTED>@")
    t = F.regexp_replace(t, P.SECRET_ASSIGNED, "$1<REDACTED>")
    for pattern in P.PROVIDER_SECRETS.values():
        t = F.regexp_replace(t, pattern, "<REDACTED>")
    t = F.when(_hinted(plain), t).otherwise(plain)
    t = F.regexp_replace(F.regexp_replace(t, r"(?m)[ \t\f\x0b]+$", ""), r"\n{4,}", "\n\n\n")
    return t if limit is None else F.substring(t, 1, limit)


def json_sanitized(value: Column, depth: int = 8, items: int = 10_000, chars: int = 20_000) -> Column:
    """JSON texts bounded and free of secrets: strings redacted and cut, deep values and long collections marked. Null if it is no JSON."""
    import json

    import pandas as pd

    patterns = [(re.compile(P.PRIVATE_KEY), "<REDACTED_PRIVATE_KEY>"), (re.compile(P.URL_CREDENTIALS), r"\1<REDACTED>@"), (re.compile(P.SECRET_ASSIGNED.replace("(?iU)", "(?i)")), r"\1<REDACTED>")]
    patterns += [(re.compile(p), "<REDACTED>") for p in P.PROVIDER_SECRETS.values()]

    def clean(s: str, most: int) -> str:
        s = re.sub("\r\n?", "\n", s.replace("\0", ""))
        for p, r in patterns:
            s = p.sub(r, s)
        return re.sub(r"\n{4,}", "\n\n\n", re.sub(r"(?m)[ \t\f\v]+$", "", s))[:most]

    def safe(x, level: int):
        if level >= depth:
            return "<MAX_DEPTH>"
        if isinstance(x, str):
            return clean(x, chars)
        if isinstance(x, dict):
            out = {clean(k, 500): safe(v, level + 1) for k, v in list(x.items())[:items]}
            return out | ({"<TRUNCATED>": len(x) - items} if len(x) > items else {})
        if isinstance(x, list):
            return [safe(v, level + 1) for v in x[:items]] + ([f"<TRUNCATED:{len(x) - items}>"] if len(x) > items else [])
        return x

    def one(s: str | None) -> str | None:
        try:
            return None if s is None else json.dumps(safe(json.loads(s), 0), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    return F.pandas_udf(lambda column: pd.Series([one(s) for s in column], dtype=object), "string")(value)


def secret_findings(text: Column) -> Column:
    """How many secrets of each category a text holds: a map without the secrets."""
    kinds = {"private_key": P.PRIVATE_KEY, "url_credentials": P.URL_CREDENTIALS, "labelled_secret": P.SECRET_ASSIGNED, **P.PROVIDER_SECRETS}
    t = F.coalesce(text, F.lit(""))
    every = F.create_map(*[x for k, p in kinds.items() for x in (F.lit(k), F.regexp_count(t, F.lit(p)))])
    return F.map_filter(every, lambda _, n: n > 0)


def has_secret(text: Column) -> Column:
    """A secret of any category, or an opaque run of 48 characters or more."""
    t = F.coalesce(text, F.lit(""))
    known = F.lit(False)
    for p in (P.PRIVATE_KEY, P.URL_CREDENTIALS, P.SECRET_ASSIGNED, *P.PROVIDER_SECRETS.values()):
        known = known | t.rlike(p)
    return t.rlike(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{48}") | (_hinted(t) & known)


def is_secret_label(text: Column) -> Column:
    return (F.length(F.trim(text)) <= 80) & F.trim(text).rlike(r"(?iU)^\s*" + P.SECRET_LABEL + r"\s*[:=\-–—]?\s*$")


def sanitized_cells(cells: Column, headers: Column) -> Column:
    """A table row with values under a secret header, or right of a secret label, replaced; other cells redacted."""

    def one(cell, i):
        under = F.coalesce(is_secret_label(F.get(headers, i)), F.lit(False))
        beside = (i > 0) & F.coalesce(is_secret_label(F.get(cells, i - 1)), F.lit(False))
        return F.when((cell != "") & (under | beside), "<REDACTED>").otherwise(redacted(cell))

    return F.transform(cells, one)


def sanitized(text: Column, most: int = 600) -> Column:
    """A text to show, or a notice in its place if it holds instructions; empty for blank texts."""
    # Only texts beyond ASCII are sent to Python; of others lower() is the same.
    fold = F.coalesce(folded(F.when(text.rlike(r"[^\x00-\x7f]"), text)), F.lower(text))
    seen = F.translate(fold, P.LOOKALIKES + P.INVISIBLE, P.LATIN)
    described = seen.rlike("(?i)^" + P.DESCRIPTIVE + r"\z")
    hit = fold.rlike("(?iU)" + P.RUSSIAN_ANSWER)
    for p in (*P.INJECTIONS, P.CONCEAL):
        for view in (text, fold, seen):
            found = view.rlike("(?iU)" + p)
            if p == P.TERMS:
                mentions = F.regexp_extract_all(view, F.lit("(?iU)" + p), F.lit(0))
                found = F.when(described, F.exists(mentions, lambda m: ~m.rlike("(?i)^" + P.TERM + r"\z"))).otherwise(found)
            hit = hit | found
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "").when(hit, P.FILTERED).otherwise(F.substring(text, 1, most))


def is_social_close(text: Column) -> Column:
    """Small talk that closes a turn; a question mark keeps it open."""
    return F.regexp_replace(F.trim(text), r"[.!…]+\s*$", "").rlike(P.SOCIAL)


def excerpt(text: Column, limit: int) -> Column:
    """Head and tail of a long text around a mark that counts what was left out; the whole text if it is short enough."""
    n = F.length(text)

    def mark(omitted: Column) -> Column:
        before, rest = P.OMITTED.split("{omitted}")
        middle, after = rest.split("{source_length}")
        return F.concat(F.lit(before), omitted.cast("string"), F.lit(middle), n.cast("string"), F.lit(after))

    m = mark(F.greatest(F.lit(0), n - limit))
    for _ in range(3):
        m = mark(F.greatest(F.lit(0), n - F.greatest(F.lit(0), F.lit(limit) - F.length(m))))
    room = F.lit(limit) - F.length(m)
    head = F.floor((room + 1) / 2).cast("int")
    cut = F.concat(F.substring(text, F.lit(1), head), m, F.when(room - head > 0, F.right(text, room - head)).otherwise(""))
    return F.when(n <= limit, text).when(room <= 0, F.substring(m, 1, limit)).otherwise(cut)


def text_health(text: Column) -> Column:
    """Whether extracted text is usable: letters and digits 25 % or more, replacement characters 10 % and controls 2 % at most."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda p: F.regexp_count(text, F.lit(p)) / n
    return (share(r"[\p{L}\p{N}]") >= 0.25) & (share("�") <= 0.10) & (share(r"[\x00-\x08\x0b\x0c\x0e-\x1f]") <= 0.02)


def choose_ocr(native: Column, ocr: Column, least: int = 20) -> Column:
    """The recognised text where it is usable, long enough and no shorter than the native one; else the native text."""
    better = text_health(ocr) & (F.length(ocr) >= least) & (F.length(ocr) >= F.length(F.coalesce(native, F.lit(""))))
    return F.when(F.coalesce(better, F.lit(False)), ocr).otherwise(native)


def chunk_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def coverage_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 3).cast("int")


def repository_path(path: Column) -> Column:
    """Slashes unified and single, no leading ./; null for absolute paths and paths that climb."""
    p = F.regexp_replace(F.regexp_replace(F.translate(F.trim(path), "\\", "/"), "/+", "/"), r"^(?:\./)+", "")
    return F.when(p.rlike(r"^/|(^|/)\.\.(/|$)") | (p == ""), None).otherwise(p)


def manifest_path(path: Column) -> Column:
    """As repository_path, without . segments and drive letters; empty instead of null."""
    p = repository_path(path)
    parts = F.array_join(F.filter(F.split(p, "/"), lambda x: ~x.isin("", ".")), "/")
    return F.when(p.isNull() | p.rlike("^[A-Za-z]:"), "").otherwise(parts)


def sha_digest(value: Column) -> Column:
    """64 lower-case hex digits, with or without sha256: before them; else null."""
    h = F.regexp_replace(F.lower(F.trim(value)), "^sha256:", "")
    return F.when(h.rlike("^[0-9a-f]{64}$"), h)


def display_uri(uri: Column) -> Column:
    """Without credentials, query and fragment."""
    return F.regexp_replace(F.regexp_replace(uri, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1")


def normalized_answer(text: Column) -> Column:
    """For exact match: lower case, no punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def identifier(prefix: str, digits: int, *parts: Column) -> Column:
    """A prefix and the first digits of the SHA-256 of the parts joined by NUL: docunit_ 28, docchunk_ 28, obs_ 24, edge_ 32, ext_ 20."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, digits))


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns as JSON in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def attributed(kind: Column, text: Column, russian: Column) -> Column:
    """A statement with whom it comes from."""
    english = F.when(kind == "preference", "User prefers: ").when(kind == "decision", "User decided: ").when(kind == "fact", "User states: ").otherwise("User asked to remember: ")
    other = F.when(kind == "preference", "Пользователь предпочитает: ").when(kind == "decision", "Пользователь решил: ").when(kind == "fact", "Пользователь сообщает: ").otherwise("Пользователь просил запомнить: ")
    return F.concat(F.when(russian, other).otherwise(english), text)


def rendered_claim(claim: Column, evidence: Column) -> Column:
    """A claim, and its evidence unless it is contained."""
    return F.when(F.coalesce(evidence, F.lit("")) == "", claim).when(F.contains(claim, evidence), claim).otherwise(F.concat(claim, F.lit("\n> "), evidence))


def contains_phrase(text: Column, phrase: str) -> Column:
    """The phrase between word ends, case aside."""
    import re

    return F.lower(text).rlike(r"(?U)(?<!\w)" + re.escape(phrase.lower()) + r"(?!\w)")


def xml_escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def event_moment(value: Column) -> Column:
    """A moment from epoch seconds, milliseconds, ISO texts or `2023/05/20 (Sat) 02:21`."""
    s = F.trim(value.cast("string"))
    number = F.when(s.rlike(r"^\d{12,}$"), F.timestamp_millis(F.try_to_number(s, F.lit("9" * 18)).cast("long"))).when(s.rlike(r"^\d{1,11}$"), F.timestamp_seconds(F.try_to_number(s, F.lit("9" * 18)).cast("long")))
    dated = F.try_to_timestamp(F.regexp_replace(s, r"\s*\([A-Za-z]{3}\)\s*", " "), F.lit("yyyy/MM/dd HH:mm"))
    return F.coalesce(number, dated, F.when(~s.rlike(r"^\d+$"), F.try_to_timestamp(s)))
