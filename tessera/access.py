"""Who may see a row: visibility predicates that go on every scan, before any limit, and so reach the Parquet reader."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Principal:
    """A reader: a bot, and within it a chat, a session and a project. Empty fields match nothing that needs them."""

    bot: str = ""
    chat: str = ""
    session: str = ""
    project: str = ""

    def sees(self, scope: str = "visibility_scope") -> Column:
        """Rows of the reader's chat session, project or bot. Columns: owner_bot_id, owner_chat_hash, owner_session_hash, project_id."""
        own = (F.col("owner_bot_id") == self.bot) & F.lit(bool(self.bot))
        chat = (F.col(scope) == "chat") & (F.col("owner_chat_hash") == self.chat) & (F.col("owner_session_hash") == self.session) & F.lit(bool(self.chat))
        project = (F.col(scope) == "project") & (F.col("project_id") == self.project) & F.lit(bool(self.project))
        return own & (chat | project | (F.col(scope) == "bot"))


def unexpired(now: int, column: str = "expires_at") -> Column:
    """Expiry in epoch seconds; 0 and null never expire."""
    return F.coalesce(F.col(column), F.lit(0)).isin(0) | (F.col(column) > now)


def valid_at(moment: int, since: str = "valid_from", until: str = "valid_to") -> Column:
    """[since, until) in epoch seconds; 0 and null are open ends."""
    return (F.coalesce(F.col(since), F.lit(0)) <= moment) & ((F.coalesce(F.col(until), F.lit(0)) == 0) | (F.col(until) > moment))


def of_kinds(column: str, kinds: list[str] | None) -> Column:
    """Membership in a set of labels; no set admits all. Labels are lower-case words of up to 64 letters, digits, _ . : -"""
    import re

    if not kinds:
        return F.lit(True)
    wrong = [k for k in kinds if not re.fullmatch(r"[a-z0-9_.:-]{1,64}", k)]
    if wrong:
        raise ValueError(f"not labels: {wrong}")
    return F.col(column).isin(sorted(set(kinds)))


def in_status(active_only: bool = True) -> Column:
    return F.col("status") == "active" if active_only else F.col("status").isin("active", "superseded")


def intact(content: str = "content", digest: str = "content_hash") -> Column:
    """The content still has the hash it was stored with."""
    return F.sha2(F.col(content), 256) == F.col(digest)


def shareable() -> Column:
    return (F.col("status") == "active") & (F.coalesce("risk", F.lit("")) != "secret") & (F.coalesce("secrecy", F.lit("public")) == "public") & ~F.coalesce("quarantined", F.lit(False))


def foreign_eligible() -> Column:
    return (F.col("visibility") == "global") & (F.col("status") == "active") & (F.coalesce("risk", F.lit("")) != "secret") & ~F.coalesce("is_artifact", F.lit(False))


def connected(rows: DataFrame, links: DataFrame, scope: str, on: str = "source_id") -> DataFrame:
    """Rows without a connector link that is inactive or belongs to another scope."""
    barred = links.where((~F.col("active")) | (F.col("scope_id") != scope)).select(on)
    return rows.join(barred, on, "left_anti")


def relations_at(relations: DataFrame, claims: DataFrame, moment: int) -> DataFrame:
    """Relations valid at a moment whose source claim, where they name one, is active."""
    live = claims.where(in_status()).select(F.col("id").alias("source_claim_id"))
    held = relations.where(valid_at(moment))
    named = F.coalesce("source_claim_id", F.lit("")) != ""
    return held.where(~named).unionByName(held.where(named).join(live, "source_claim_id", "left_semi").select(*held.columns))


def bound_to(repositories: list[str] | None, paths: str | None = None, first: int | None = None, last: int | None = None) -> Column:
    """Rows of the repositories that a reader is bound to (None: of any; an empty list: none), below a path, within a range of lines.

    Columns: repository_id, path, line. A path is a whole segment or more: "src" holds "src/a.py" and not "srcs".
    """
    own = F.lit(True) if repositories is None else F.col("repository_id").isin(sorted(set(repositories))) if repositories else F.lit(False)
    if paths:
        own &= (F.col("path") == paths.rstrip("/")) | F.col("path").startswith(paths.rstrip("/") + "/")
    if first is not None:
        own &= F.col("line") >= first
    return own if last is None else own & (F.col("line") <= last)


def accepted(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, rows that break one, with the first broken rule's name)."""
    reason = F.coalesce(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]) if rules else F.lit(None)
    marked = rows.withColumn("rejected_for", reason)
    return marked.where("rejected_for is null").drop("rejected_for"), marked.where("rejected_for is not null")


def claim_rules() -> dict[str, Column]:
    return {"claim length": F.length("claim").between(10, 8000)}


def episode_rules() -> dict[str, Column]:
    return {"role": F.col("role").isin("user", "assistant")}


def without_erased(rows: DataFrame, erased: DataFrame, key: str = "digest") -> DataFrame:
    """Rows whose exact digest was not erased."""
    return rows.join(erased.select(key), key, "left_anti")


def unchanged(before: DataFrame, after: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Rows of before whose fingerprint after is the same: what may still be disclosed."""
    return before.join(after.select(key, F.col(fingerprint).alias("_now")), key).where(F.col(fingerprint) == F.col("_now")).drop("_now")


def visible_columns(rows: DataFrame) -> DataFrame:
    """Without columns that begin with an underscore and raw texts."""
    return rows.select(*[c for c in rows.columns if not c.startswith("_") and c not in ("raw_text", "content_hash")])
