"""Stations, their tokens, and requests made with them."""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytide.session import ship, stage

#: Registry tables of up to this many rows travel to the requests; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if a count proves that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bearer(header: Column) -> Column:
    """The token of an authorization header; null unless it begins with "Bearer " exactly."""
    return F.when(header.startswith("Bearer "), F.substr(header, F.lit(8)))


def authenticate(requests: DataFrame, tokens: DataFrame, stations: DataFrame) -> DataFrame:
    """requests (``request_id, header``) with ``station_id`` (null if unauthorised) and ``status`` (200 or 401). A token is
    good if neither it nor its station is revoked."""
    active = tokens.where("revoked_at IS NULL").join(stations.where("revoked_at IS NULL").select(F.col("id").alias("station_id")), "station_id", "left_semi").select("token_hash", "station_id").dropDuplicates(["token_hash"])
    hashed = requests.withColumn("token_hash", F.sha2(bearer(F.col("header")), 256))
    return hashed.join(small(active), "token_hash", "left").select("request_id", "station_id", F.when(F.col("station_id").isNotNull(), 200).otherwise(401).alias("status"))


def list_stations(stations: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each station with its number of active tokens, oldest first; stations without tokens have 0."""
    n = tokens.where("revoked_at IS NULL").groupBy("station_id").agg(F.count("token_hash").alias("n"))
    return stations.join(n, stations["id"] == n["station_id"], "left").select("id", "created_at", "revoked_at", F.coalesce("n", F.lit(0)).alias("active_tokens")).orderBy("created_at")


def list_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens by the first twelve digits of their hash."""
    return tokens.select("station_id", F.left("token_hash", F.lit(12)).alias("prefix"), "created_at", "revoked_at").orderBy("created_at")


def resolve(prefixes: DataFrame, stations: DataFrame) -> DataFrame:
    """``prefix, matches, id``: the station that a prefix of its id means; id only if there is exactly one.

    An id is matched by its own prefixes, an equi-join, so the work doesn't grow with the product of both sides.
    """
    own = stations.select("id", F.explode(F.sequence(F.lit(0), F.length("id"))).alias("n")).select("id", F.left("id", F.col("n")).alias("prefix"))
    found = prefixes.select("prefix").distinct().join(own, "prefix", "left").groupBy("prefix").agg(F.count("id").alias("matches"), F.min("id").alias("id"))
    return found.select("prefix", "matches", F.when(F.col("matches") == 1, F.col("id")).alias("id"))


def revoke_tokens(tokens: DataFrame, orders: DataFrame, at) -> DataFrame:
    """tokens after revoking those that orders (``station_id, prefix``) name and that aren't revoked yet; ``revoked_now``
    marks them."""
    o = orders.select("station_id", "prefix").distinct()
    same = (tokens["station_id"] == o["station_id"]) & tokens["token_hash"].startswith(o["prefix"])
    hit = tokens.join(small(o), same, "left_semi").where("revoked_at IS NULL").select(F.col("token_hash").alias("h")).distinct()
    out = tokens.join(hit, tokens["token_hash"] == hit["h"], "left").withColumn("revoked_now", F.col("h").isNotNull())
    return out.withColumn("revoked_at", F.when(F.col("revoked_now"), at).otherwise(F.col("revoked_at"))).drop("h")


def revoke_station(stations: DataFrame, ids: DataFrame, at) -> DataFrame:
    """stations after revoking those in ids (``id``) that aren't revoked yet."""
    hit = ids.select(F.col("id").alias("h")).distinct()
    out = stations.join(small(hit), stations["id"] == hit["h"], "left")
    return out.withColumn("revoked_at", F.when(F.col("h").isNotNull() & F.col("revoked_at").isNull(), at).otherwise(F.col("revoked_at"))).drop("h")


def add_station(stations: DataFrame, new: DataFrame) -> DataFrame:
    """stations with further ones (``created_at``), each under a new random id."""
    return stations.unionByName(new.select(F.expr("uuid()").alias("id"), "created_at", F.lit(None).cast("timestamp").alias("revoked_at")))


def mint_tokens(stations: DataFrame, at) -> tuple[DataFrame, DataFrame]:
    """A new token for each of stations (``id``; a station may be named several times): rows for the table of tokens, which
    holds hashes only, and ``station_id, token`` to hand out once. Tokens are 32 random bytes in hexadecimal digits. They are
    drawn once and written to the shared folder, so that both frames show the same ones."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [secrets.token_hex(32) for _ in range(b.num_rows)]
            hashes = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string()), pa.array(hashes, pa.string())], names=["station_id", "token", "token_hash"])

    ship(stations.sparkSession)
    drawn = stage(stations.select("id").mapInArrow(draw, "station_id STRING, token STRING, token_hash STRING"), "tokens")
    rows = drawn.select("token_hash", "station_id", at.alias("created_at"), F.lit(None).cast("timestamp").alias("revoked_at"))
    return rows, drawn.select("station_id", "token")
