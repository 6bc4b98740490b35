"""Keys, spending, retention, jobs, uploads and review as relations."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXTENSIONS = (".pdf", ".png", ".jpg", ".jpeg", ".tiff")
MAX_UPLOAD = 100 * 1024 * 1024
DAY = 86_400
# Seconds waited before the second and third try of a delivery.
RETRIES = (1, 4)
# The status of each outcome of the job service.
STATUSES = {"missing_key": 401, "inactive": 401, "budget_exhausted": 429, "not_found": 404, "forbidden": 403, "pending": 202, "too_large": 413, "invalid_upload": 422, "bad_callback": 400, "ok": 200}
# Kinds of errors with the label and status they are reported by.
ERRORS = {"ValueError": ("invalid input", 400), "KeyError": ("not found", 404), "FileNotFoundError": ("not found", 404), "PermissionError": ("forbidden", 403)}


def status_of(kind: Column) -> Column:
    """The HTTP status of an outcome; 500 for one that isn't known."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in STATUSES.items() for x in kv])[kind], F.lit(500))


def error_report(kind: Column, detail: Column, production: bool = True) -> Column:
    """struct(status, detail) of an error: in production its label instead of its own words; an unknown kind is an internal error."""
    label = F.coalesce(F.create_map(*[F.lit(x) for k, (l, _) in ERRORS.items() for x in (k, l)])[kind], F.lit("internal error"))
    status = F.coalesce(F.create_map(*[F.lit(x) for k, (_, n) in ERRORS.items() for x in (k, n)])[kind], F.lit(500))
    return F.struct(status.alias("status"), (label if production else detail).alias("detail"))


def token_check(expected: Column, cookie: Column, parameter: Column) -> Column:
    """200 where no token is set or the given one is right, 403 otherwise; a cookie goes before a query parameter."""
    given = F.coalesce(cookie, parameter)
    return F.when(expected.isNull(), 200).when(F.coalesce(given == expected, F.lit(False)), 200).otherwise(403)


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(\.[^.]+)$", 1))


def upload_check(size: Column, filename: Column, head: Column) -> Column:
    """ok, too_large, bad_format or fake_pdf."""
    ext = extension(filename)
    return F.when(size > MAX_UPLOAD, "too_large").when(~F.coalesce(ext, F.lit("")).isin(*EXTENSIONS), "bad_format").when((ext == ".pdf") & ~F.coalesce(F.startswith(head, F.lit("%PDF-")), F.lit(False)), "fake_pdf").otherwise("ok")


def hour_bucket(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHH")


def spend_buckets(events: DataFrame) -> DataFrame:
    """Cents per key and hour; whole cents, so sums don't depend on their order."""
    cents = F.round(F.col("value") * 100).cast("long")
    return events.groupBy(F.col("user_id").alias("key_id"), hour_bucket(F.col("ts")).alias("bucket")).agg(F.sum(cents).alias("cents"))


def spend_totals(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("key_id").agg(F.sum("cents").alias("cents"))


def key_status(keys: DataFrame, totals: DataFrame) -> DataFrame:
    """Why a key is refused, or ok: keys (key_id, active, budget_cents) against what was spent."""
    spent = F.coalesce("cents", F.lit(0))
    reason = F.when(F.col("active").isNull(), "missing_key").when(~F.col("active"), "inactive").when(spent >= F.col("budget_cents"), "budget_exhausted").otherwise("ok")
    return keys.join(totals, "key_id", "full_outer").select("key_id", spent.alias("cents"), reason.alias("status"))


def registered(keys: DataFrame) -> DataFrame:
    """The latest registration of each key (key_id, budget_cents, at)."""
    return keys.groupBy("key_id").agg(F.max_by(F.struct(F.coalesce("budget_cents", F.lit(100)).alias("budget_cents")), "at").alias("k")).select("key_id", F.col("k.budget_cents").alias("budget_cents"), F.lit(True).alias("active"))


def expired_buckets(buckets: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Spend buckets from before the cut-off; a malformed bucket never expires."""
    at = F.try_to_timestamp("bucket", F.lit("yyyyMMddHH"))
    return buckets.filter(at < F.to_timestamp(F.lit(now)) - F.expr(f"interval {days} days"))


def expired_entries(entries: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Job and review entries (entry_kind, created_at) that are too old or have no time; lists and spend buckets stay."""
    old = F.col("created_at").isNull() | (F.col("created_at") < F.to_timestamp(F.lit(now)) - F.expr(f"interval {days} days"))
    return entries.filter((F.col("entry_kind") == "dict") & old)


def rate_limited(events: DataFrame, limit: int) -> DataFrame:
    """Requests per key and minute beyond the limit, with the seconds to wait. Numbered inside a key's minute."""
    minute = F.date_trunc("minute", "ts")
    n = F.row_number().over(Window.partitionBy(F.coalesce(F.col("user_id").cast("string"), F.lit("anonymous")), minute).orderBy("ts", "event_id"))
    wait = (60 - F.second("ts")).cast("int")
    return events.withColumn("n", n).filter(F.col("n") > limit).select("event_id", "user_id", "n", wait.alias("retry_after_s"))


def latest_jobs(results: DataFrame) -> DataFrame:
    """One row per job: the delivery received last, and how many there were."""
    return results.groupBy("job_id").agg(F.count("*").alias("deliveries"), F.max_by(F.struct("result_key", "doc_id", "api_key_hash"), F.struct("received_at", "result_key")).alias("r")).select("job_id", "deliveries", "r.*")


def job_status(results: DataFrame, at: str) -> DataFrame:
    """Status of each job as asked at a time: completed once a result had been received, processing before."""
    return results.groupBy("job_id").agg(F.min("submitted_at").alias("submitted_at"), F.min("received_at").alias("received_at")).filter(F.col("submitted_at") <= F.to_timestamp(F.lit(at))).select("job_id", F.when(F.col("received_at") <= F.to_timestamp(F.lit(at)), "completed").otherwise("processing").alias("status"))


def owned(jobs: DataFrame, key_hash: Column) -> Column:
    """404 for an unknown job, 403 for another's, else 200."""
    return F.when(F.col("api_key_hash").isNull(), 404).when(F.col("api_key_hash") != key_hash, 403).otherwise(200)


def webhook_summary(results: DataFrame) -> DataFrame:
    """What a finished job's callback says."""
    number = lambda k: F.coalesce(F.expr(f"try_cast(metadata['{k}'] as int)"), F.lit(0))
    return results.select("result_key", "job_id", F.lit("completed").alias("status"), number("page_count").alias("page_count"), number("total_page_count").alias("total_page_count"), F.coalesce("filename", F.lit("")).alias("filename"))


def pads(secret: bytes) -> tuple[bytes, bytes]:
    """What a keyed hash puts before its message, inside and outside: the key, filled up to a block of 64 bytes, with fixed bits turned."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def signature(secret: str, body: Column) -> Column:
    """Hexadecimal HMAC-SHA256 of a text, from the built-in hash; null for null."""
    inner, outer = (F.lit(bytearray(p)) for p in pads(secret.encode()))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(body, "UTF-8")), 256))), 256)


def delivery_attempts(events: DataFrame) -> DataFrame:
    """Tries of a delivery: each failed one (status null or at least 400) is followed by the next after its wait; ``events``: id, statuses array in order."""
    tried = F.slice("statuses", 1, len(RETRIES) + 1)
    good = F.transform(tried, lambda s: F.coalesce(s < 400, F.lit(False)))
    n = F.when(F.array_contains(good, True), F.array_position(good, True)).otherwise(F.size(tried)).cast("int")
    waits = F.aggregate(F.slice(F.array(*[F.lit(w) for w in RETRIES]), 1, F.greatest(n - 1, F.lit(0))), F.lit(0), lambda a, w: a + w)
    return events.select("id", n.alias("attempts"), F.array_contains(good, True).alias("delivered"), waits.alias("waited_s"))


# Address ranges that aren't public (private, loopback, link-local, reserved).
NOT_PUBLIC = r"^(?:0\.|10\.|127\.|169\.254\.|172\.(?:1[6-9]|2\d|3[01])\.|192\.168\.|192\.0\.[02]\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|2[4-5]\d\.|::1?$|::ffff:|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|100::|2001:db8:)"


def callback_check(url: Column, addresses: Column) -> Column:
    """ok or why a callback address is refused: https on port 443 only, a host, no user information, and public ``addresses`` only (what the host resolves to: an array, null or empty if it doesn't)."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    port = F.regexp_extract(F.coalesce(part("AUTHORITY"), F.lit("")), r":(\d+)$", 1)
    private = F.exists(addresses, lambda a: F.coalesce(F.lower(a).rlike(NOT_PUBLIC), F.lit(True)))
    return F.when(F.coalesce(part("PROTOCOL"), F.lit("")) != "https", "not_https").when(~port.isin("", "443"), "bad_port").when(F.coalesce(part("HOST"), F.lit("")) == "", "no_host").when(part("USERINFO").isNotNull(), "userinfo").when(F.coalesce(F.size(addresses), F.lit(0)) < 1, "unresolvable").when(private, "private_address").otherwise("ok")


def review_queue(reviewed: DataFrame) -> DataFrame:
    """Open reviews per job."""
    one = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).cast("long").alias(s)
    return reviewed.groupBy("job_id").agg(F.count("*").alias("regions"), one("pending"), one("reviewed"), one("partial"))


def corrected(reviewed: DataFrame) -> DataFrame:
    """Text after review: the correction where there is one."""
    return reviewed.select("hitl_key", "job_id", F.coalesce("corrected_text", "consensus_text").alias("text"), F.col("corrected_text").isNotNull().alias("was_corrected"))


def with_corrections(reviewed: DataFrame, payload: DataFrame) -> DataFrame:
    """The whole review table as it is to be written back: regions of a job whose id is in its payload (job_id, corrections map) take the correction from there."""
    new = F.col("corrections")[F.col("region_id")]
    joined = reviewed.join(payload.select("job_id", "corrections"), "job_id", "left")
    return joined.select(*[F.coalesce(new, F.col(c)).alias(c) if c == "corrected_text" else F.col(c) for c in reviewed.columns])


def corrections_applied(payload: DataFrame) -> DataFrame:
    """What the answer to a review says: the size of its payload, even of ids that aren't known."""
    return payload.select("job_id", F.lit("updated").alias("status"), F.coalesce(F.size("corrections"), F.lit(0)).alias("corrections_applied"))


def upserted(store: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """A key-value table after changes in the order of ``at``: the last one of a key counts, one that is ``deleted`` takes it away. The result is to be written in place of the table."""
    values = [c for c in store.columns if c not in keys]
    both = store.select(*keys, *values, F.lit(None).cast("timestamp").alias("at"), F.lit(False).alias("deleted")).unionByName(changes.select(*keys, *values, "at", "deleted"))
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*values, "deleted"), F.struct(F.col("at").isNotNull().alias("a"), F.col("at").alias("b"))).alias("v"))
    return last.filter("not v.deleted").select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def result_metadata(pages: DataFrame) -> DataFrame:
    """What a finished result says of itself; ``pages``: doc_id, filename, processed, hitl_flags, one row per valid page. Without any processed page all counts are 0."""
    done = F.col("processed")
    got = pages.groupBy("doc_id").agg(F.sum(done.cast("int")).cast("int").alias("page_count"), F.count("*").cast("int").alias("total_page_count"), F.max("filename").alias("filename"), F.sum(F.when(done, F.col("hitl_flags")).otherwise(0)).cast("long").alias("hitl_flag_count"))
    return got.withColumn("budget_exceeded", F.col("page_count") < F.col("total_page_count"))
