"""Claims about code: by repository, file and symbol, how they stand to the present snapshot, and what patches did to them.

metadata: claim_id, repository_id, file_path, symbol_id, symbol_revision, content_hash. outcomes: repository_id, patch_id, claim_id,
outcome, old_content_hash, new_content_hash, changed_files and changed_symbols (arrays in JSON), created_at, updated_at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUTCOMES = ("applied", "failed", "rolled_back", "pending")


def code_claims(claims: DataFrame, metadata: DataFrame, repository: str | None = None, path: str | None = None, symbol: str | None = None, active_only: bool = True) -> DataFrame:
    """Claims (id, status) with their metadata, by any of repository, file path and symbol; what isn't asked for isn't restricted."""
    own = metadata
    for column, value in (("repository_id", repository), ("file_path", path), ("symbol_id", symbol)):
        own = own if value is None else own.where(F.col(column) == value)
    live = claims.where("status = 'active'") if active_only else claims
    return live.join(own.withColumnRenamed("claim_id", "id"), "id")


def standing(metadata: DataFrame, symbols: DataFrame) -> DataFrame:
    """metadata with standing against symbols(repository_id, symbol_id, content_hash): current, stale if the content is another, or orphaned."""
    now = symbols.select("repository_id", "symbol_id", F.col("content_hash").alias("_now"))
    both = metadata.join(now, ["repository_id", "symbol_id"], "left")
    state = F.when(F.col("_now").isNull(), "orphaned").when(F.col("_now") == F.col("content_hash"), "current").otherwise("stale")
    return both.withColumn("standing", state).drop("_now")


def symbol_revisions(metadata: DataFrame) -> DataFrame:
    """Each symbol's revisions in order: claims, the revision before, whether its content changed, and its place. Ties of a revision's contents: the least hash."""
    each = metadata.groupBy("repository_id", "symbol_id", "symbol_revision").agg(F.count("*").alias("claims"), F.min("content_hash").alias("content_hash"))
    w = Window.partitionBy("repository_id", "symbol_id").orderBy("symbol_revision")
    return each.withColumns({"place": F.row_number().over(w), "before": F.lag("symbol_revision").over(w), "changed": ~F.lag("content_hash").over(w).eqNullSafe(F.col("content_hash"))})


def recorded_outcomes(known: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each (repository, patch): what was recorded last, with the first created_at. Unknown outcomes count as pending."""
    every = known.unionByName(new).withColumn("outcome", F.when(F.lower(F.trim("outcome")).isin(*OUTCOMES), F.lower(F.trim("outcome"))).otherwise("pending"))
    last = every.groupBy("repository_id", "patch_id").agg(
        F.min("created_at").alias("_first"), F.max_by(F.struct(*[c for c in every.columns if c not in ("repository_id", "patch_id", "created_at")]), F.struct("updated_at", F.xxhash64(*every.columns))).alias("_r")
    )
    return last.select("repository_id", "patch_id", "_r.*", F.col("_first").alias("created_at")).select(*every.columns)


def patched(outcomes: DataFrame, metadata: DataFrame) -> DataFrame:
    """(claim_id, repository_id, patch_id, effect) for claims on what an applied or rolled back patch changed.

    A claim is meant by its symbol, or by its file if the patch names no symbol. effect: invalidated if it was made on the old
    content, confirmed if on the new, else unclear; a patch rolled back has it the other way round.
    """
    names = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    done = outcomes.where(F.col("outcome").isin("applied", "rolled_back")).withColumns({"_files": names("changed_files"), "_symbols": names("changed_symbols")})
    before = F.when(F.col("outcome") == "applied", F.col("old_content_hash")).otherwise(F.col("new_content_hash"))
    after = F.when(F.col("outcome") == "applied", F.col("new_content_hash")).otherwise(F.col("old_content_hash"))
    own = done.select("repository_id", "patch_id", before.alias("_old"), after.alias("_new"), "_files", "_symbols")
    by_symbol = own.select("repository_id", "patch_id", "_old", "_new", F.explode(F.array_distinct("_symbols")).alias("symbol_id")).join(metadata.select("claim_id", "repository_id", "symbol_id", "content_hash"), ["repository_id", "symbol_id"])
    by_file = own.where("size(_symbols) = 0").select("repository_id", "patch_id", "_old", "_new", F.explode(F.array_distinct("_files")).alias("file_path")).join(metadata.select("claim_id", "repository_id", "file_path", "content_hash"), ["repository_id", "file_path"])
    effect = F.when(F.col("content_hash") == F.col("_old"), "invalidated").when(F.col("content_hash") == F.col("_new"), "confirmed").otherwise("unclear")
    columns = ["claim_id", "repository_id", "patch_id", effect.alias("effect")]
    return by_symbol.select(*columns).unionByName(by_file.select(*columns))


def repository_context(claims: DataFrame, metadata: DataFrame, symbols: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What is known of each repository: claims that are active, and of these current, stale and orphaned; files and symbols that they name; patches by outcome."""
    own = standing(code_claims(claims.select("id", "status"), metadata), symbols)
    count = lambda s: F.count_if(F.col("standing") == s).alias(s)
    known = own.groupBy("repository_id").agg(F.count("*").alias("claims"), count("current"), count("stale"), count("orphaned"), F.count_distinct("file_path").alias("files"), F.count_distinct("symbol_id").alias("symbols"))
    patches = outcomes.groupBy("repository_id").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    both = known.join(patches, "repository_id", "full")
    return both.select("repository_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in both.columns if c != "repository_id"])
