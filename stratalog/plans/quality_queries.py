"""Quality rules, routing and publication over the given tables, with faults derived from the keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.functions import numbers, text
from stratalog.operators import evidence, quality, release, routing
from stratalog.plans.call_queries import DAILY_SQL, daily
from stratalog.plans.registry import query
from stratalog.plans.views import INTERVALS_SQL, MEMBERS_SQL, SCAN_SQL, SITES_SQL, intervals as ranges, km_sql, members, scan, sites, spectra
from stratalog.session import dealt, settle_table, table

# ---------------------------------------------------------------- rules


@query("incomplete_identities", "SELECT 'identity complete' AS rule, CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 15 = 0 THEN 'a,b' WHEN o_orderkey % 5 = 0 THEN 'a' ELSE 'b' END AS detail FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 3 = 0")
def incomplete_identities(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, "x").alias("a"), F.when(F.col("o_orderkey") % 3 == 0, "  ").otherwise("y").alias("b"))
    return quality.identity_complete(rows, key=["o_orderkey"], columns=["a", "b"])


@query("unknown_tokens", "SELECT 'known tokens' AS rule, CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS detail FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def unknown_tokens(spark, folder):
    return quality.known_tokens(table(spark, folder, "orders"), key=["o_orderkey"], column="o_orderstatus", tokens=["F", "O"])


@query("repeated_keys", "SELECT 'unique key' AS rule, l_orderkey || '/' || l_linenumber AS key, CAST(count(*) AS VARCHAR) AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def repeated_keys(spark, folder):
    return quality.unique_key(table(spark, folder, "lineitem"), key=["l_orderkey", "l_linenumber"])


@query(
    "row_count_mismatches",
    """WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT c_custkey AS k, CAST(10 AS BIGINT) AS n FROM customer)
SELECT 'row count' AS rule, CAST(coalesce(o.k, e.k) AS VARCHAR) AS key, 'observed ' || coalesce(CAST(o.n AS VARCHAR), 'null') || ', expected ' || coalesce(CAST(e.n AS VARCHAR), 'null') AS detail
FROM o FULL JOIN e ON o.k = e.k WHERE o.n IS DISTINCT FROM e.n""",
)
def row_count_mismatches(spark, folder):
    seen = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    wanted = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), F.lit(10).cast("long").alias("n"))
    return quality.row_counts(seen, wanted, key=["k"])


@query("log_rows_off_axis", "SELECT 'row on axis' AS rule, CAST(l_partkey AS VARCHAR) AS key, CAST(l_orderkey AS VARCHAR) AS detail FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def log_rows_off_axis(spark, folder):
    axis = table(spark, folder, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return quality.on_axis(table(spark, folder, "lineitem").select("l_partkey", "l_orderkey"), axis, key=["l_partkey"], on=["l_orderkey"])


@query(
    "depth_vector_disagreements",
    f"""WITH {SCAN_SQL} SELECT 'one depth vector' AS rule, CAST(hole AS VARCHAR) AS key, '2 vectors' AS detail FROM scan WHERE hole % 4 = 1 GROUP BY hole""",
)
def depth_vector_disagreements(spark, folder):
    from stratalog.operators.align import axis_digests

    rows = scan(spark, folder).select("hole", "sample_no", "us", F.explode(F.array(F.lit(0), F.lit(1))).alias("log"))
    moved = F.when((F.col("log") == 1) & (F.col("hole") % 4 == 1) & (F.col("sample_no") == 0), F.col("us") - 1).otherwise(F.col("us"))
    digests = axis_digests(rows.select("hole", "log", F.col("sample_no").alias("source_row"), moved.alias("start"), moved.alias("end")), log=["hole", "log"])
    return quality.one_depth_vector(digests, hole=["hole"])


@query(
    "axis_extent_problems",
    f"""WITH {SCAN_SQL}, a AS (SELECT hole, count(*) AS n FROM scan GROUP BY 1)
SELECT 'axis extent' AS rule, CAST(hole AS VARCHAR) AS key, CASE WHEN hole % 4 = 1 THEN 'sample count' ELSE 'depth range' END AS detail FROM a WHERE hole % 4 IN (1, 2)""",
)
def axis_extent_problems(spark, folder):
    samples = scan(spark, folder).select("hole", "sample_no", F.col("depth_h").alias("md_m"))
    axes = samples.groupBy("hole").agg(F.count(F.lit(1)).alias("n"), F.min("md_m").alias("a"), F.max("md_m").alias("b"))
    axes = axes.select("hole", F.when(F.col("hole") % 4 == 1, F.col("n") + 1).otherwise(F.col("n")).alias("sample_count"), "a", "b")
    axes = axes.select("hole", "sample_count", F.col("a").alias("depth_min_m"), F.when(F.col("hole") % 4 == 2, F.col("b") + 1).otherwise(F.col("b")).alias("depth_max_m"))
    return quality.axis_extent(axes, samples, key=["hole"])


def _interval_table(spark, folder):
    samples = scan(spark, folder)
    ident = lambda k: F.concat_ws("-", F.lit(k), F.col("hole").cast("string"), F.col("ordinal").cast("string"))
    trays = ranges(samples, 10, "tray").select(
        ident("t").alias("interval_id"), "hole", "ordinal", F.col("kind").alias("interval_kind"), F.lit(None).cast("string").alias("parent_interval_id"),
        "sample_no_from", "sample_no_to", F.col("depth_min").alias("observed_depth_min_m"), F.when(F.col("ordinal") % 6 == 5, F.col("depth_max") + 1).otherwise(F.col("depth_max")).alias("observed_depth_max_m"),
    )
    parent = F.concat_ws("-", F.lit("t"), F.col("hole").cast("string"), F.floor(F.col("ordinal") / 2).cast("string"))
    sections = ranges(samples, 5, "section").select(
        ident("s").alias("interval_id"), "hole", "ordinal", F.col("kind").alias("interval_kind"), parent.alias("parent_interval_id"),
        "sample_no_from", F.when(F.col("ordinal") % 8 == 7, F.col("sample_no_to") + 3).otherwise(F.col("sample_no_to")).alias("sample_no_to"), F.col("depth_min").alias("observed_depth_min_m"), F.col("depth_max").alias("observed_depth_max_m"),
    )
    return samples, trays, sections


@query(
    "sections_outside_trays",
    f"""WITH {SCAN_SQL}, {INTERVALS_SQL.strip()} SELECT 'section in tray' AS rule, 's-' || s.hole || '-' || s.ordinal AS key, 'parent is not a tray or does not contain the section' AS detail
FROM section s JOIN tray t ON t.hole = s.hole AND t.ordinal = s.ordinal // 2 WHERE s.ordinal % 8 = 7 AND s.sample_no_to + 3 > t.sample_no_to""",
)
def sections_outside_trays(spark, folder):
    _, trays, sections = _interval_table(spark, folder)
    return quality.section_in_tray(trays.unionByName(sections))


@query(
    "interval_depth_problems",
    f"""WITH {SCAN_SQL}, {INTERVALS_SQL.strip()} SELECT 'interval depth range' AS rule, 't-' || hole || '-' || ordinal AS key FROM tray WHERE ordinal % 6 = 5""",
)
def interval_depth_problems(spark, folder):
    samples, trays, _ = _interval_table(spark, folder)
    found = quality.interval_depths(trays, samples.withColumn("md_m", F.col("depth_h")), axis="hole")
    return found.select("rule", "key")


@query(
    "sample_membership_problems",
    f"""WITH {SCAN_SQL} SELECT 'sample membership' AS rule, hole || '/' || sample_no AS key, CASE WHEN sample_no % 50 = 7 THEN 'nesting' ELSE 'position' END AS detail FROM scan WHERE sample_no % 50 IN (7, 9)""",
)
def sample_membership_problems(spark, folder):
    samples, trays, sections = _interval_table(spark, folder)
    sections = sections.withColumn("sample_no_to", F.col("sample_no_from") + 4)
    no = F.col("sample_no")
    tray_no = F.floor(no / 10)
    name = lambda k, n: F.concat_ws("-", F.lit(k), F.col("hole").cast("string"), n.cast("string"))
    other = F.when(no % 50 == 7, F.lit(0) - 1).otherwise(F.lit(0))
    placed = samples.select(
        "hole", "sample_no", name("t", tray_no).alias("tray_interval_id"), name("s", F.floor(no / 5)).alias("section_interval_id"),
        (no - tray_no * 10 + 1).alias("tray_sample_no"), (no - F.floor(no / 5) * 5 + F.when(no % 50 == 9, 2).otherwise(1)).alias("section_sample_no"), other.alias("o"),
    )
    # a wrong parent for the section of every 50th sample's tray would touch its neighbours too: give those samples their own section
    lone = placed.where("o < 0").select(
        F.concat_ws("-", F.lit("x"), F.col("hole").cast("string"), no.cast("string")).alias("interval_id"), "hole", F.lit(0).cast("long").alias("ordinal"), F.lit("section").alias("interval_kind"),
        F.lit("nowhere").alias("parent_interval_id"), F.floor(no / 5).cast("long").alias("_f"),
    ).select("interval_id", "hole", "ordinal", "interval_kind", "parent_interval_id", (F.col("_f") * 5).alias("sample_no_from"), (F.col("_f") * 5 + 4).alias("sample_no_to"))
    placed = placed.withColumn("section_interval_id", F.when(F.col("o") < 0, F.concat_ws("-", F.lit("x"), F.col("hole").cast("string"), no.cast("string"))).otherwise(F.col("section_interval_id")))
    every = trays.unionByName(sections).select(*lone.columns).unionByName(lone)
    return quality.sample_membership(placed, every, axis="hole")


@query(
    "chunk_sequence_problems",
    """WITH c AS (SELECT l_suppkey AS a, l_linenumber - 1 AS g, count(*) AS n FROM lineitem GROUP BY 1, 2),
r AS (SELECT a, g, sum(n) OVER (PARTITION BY a ORDER BY g) - n AS f, sum(n) OVER (PARTITION BY a ORDER BY g) + CASE WHEN a % 10 = 3 AND g = 2 THEN 1 ELSE 0 END AS t FROM c),
s AS (SELECT *, lag(t) OVER (PARTITION BY a ORDER BY g) AS p, row_number() OVER (PARTITION BY a ORDER BY g) - 1 AS i FROM r)
SELECT 'chunk sequence' AS rule, a || '/' || g AS key, CAST(f AS VARCHAR) AS detail FROM s WHERE g <> i OR f <> coalesce(p, 0)""",
)
def chunk_sequence_problems(spark, folder):
    from stratalog.operators.ordered import ordered_scan, upto

    counts = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("asset_id"), (F.col("l_linenumber") - 1).alias("row_group")).agg(F.count(F.lit(1)).alias("n"))
    chunks = ordered_scan(counts, ["asset_id"], ["row_group"], {"end": upto("sum", "n")}, block=F.floor(F.col("row_group") / 65536))
    late = F.when((F.col("asset_id") % 10 == 3) & (F.col("row_group") == 2), 1).otherwise(0)
    chunks = chunks.select("asset_id", "row_group", (F.col("end") - F.col("n")).alias("source_row_from"), (F.col("end") + late).alias("source_row_to_exclusive"))
    return quality.chunk_sequence(chunks)


@query(
    "chunk_row_total_problems",
    """SELECT 'chunk row total' AS rule, CAST(l_suppkey AS VARCHAR) AS key, 'observed ' || count(*) || ', expected ' || (count(*) + 1) AS detail FROM lineitem WHERE l_suppkey % 7 = 2 GROUP BY l_suppkey""",
)
def chunk_row_total_problems(spark, folder):
    chunks = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("log_id"), "l_linenumber").agg(F.count(F.lit(1)).alias("row_count"))
    logs = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("log_id")).agg((F.count(F.lit(1)) + F.max(F.when(F.col("l_suppkey") % 7 == 2, 1).otherwise(0))).alias("observed_row_count"))
    return quality.chunk_row_totals(chunks, logs)


@query(
    "binding_problems",
    """SELECT 'binding stated' AS rule, CAST(p_partkey AS VARCHAR) AS key, 'no binding row' AS detail FROM part WHERE p_partkey % 6 = 0
UNION ALL SELECT 'chunk binding', p_partkey || '/0', CASE WHEN p_partkey % 6 = 0 THEN 'none' WHEN p_partkey % 6 = 1 THEN 'pending' ELSE 'verified' END FROM part WHERE p_partkey % 6 IN (0, 1, 2)
UNION ALL SELECT 'payload presence', CAST(p_partkey AS VARCHAR), 'payload of an unavailable log' FROM part WHERE p_size % 5 = 0
UNION ALL SELECT 'payload presence', CAST(p_partkey AS VARCHAR), 'no raw payload' FROM part WHERE p_size % 5 > 0 AND p_partkey % 4 = 3""",
)
def binding_problems(spark, folder):
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("log_id"), "p_size")
    logs = part.withColumn("availability_status", F.when(F.col("p_size") % 5 == 0, "metadata_only").otherwise("payload_present"))
    bindings = part.where("log_id % 6 <> 0").select("log_id", F.when(F.col("log_id") % 6 == 2, "other").otherwise("axis").alias("axis_id"), F.when(F.col("log_id") % 6 == 1, "pending").otherwise("verified").alias("status"))
    chunks = part.select("log_id", F.lit(0).alias("row_group"), F.lit("axis").alias("axis_id"), F.lit("sample_index").alias("coordinate_kind"))
    assets = part.select("log_id", F.col("log_id").alias("asset_id"), F.when(F.col("log_id") % 4 == 3, "canonical").otherwise("raw_source").alias("role"))
    return quality.all_of([quality.binding_rows(logs, bindings), quality.chunk_bindings(chunks, bindings), quality.payload_presence(logs, assets)])


@query(
    "asset_problems",
    """SELECT 'asset relation' AS rule, CAST(l_orderkey AS VARCHAR) AS key, CAST(l_partkey AS VARCHAR) AS detail FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)
UNION ALL SELECT 'location identity', CAST(p_partkey AS VARCHAR), 'h' || (p_partkey + 1) FROM part WHERE p_partkey % 50 = 1""",
)
def asset_problems(spark, folder):
    # dealt by pairs, in parts of bounded size: pairs are made distinct, looked up and compared where they are
    users = dealt(table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("log_id"), F.col("l_partkey").alias("asset_id")), ["log_id", "asset_id"]).distinct()
    sized = table(spark, folder, "part").select(F.col("p_partkey").alias("asset_id"), "p_size")
    known = users.join(sized, "asset_id").select("log_id", "asset_id", F.when(F.col("p_size") == 7, "raw").otherwise("canonical").alias("role"))
    hashes = sized.select("asset_id", F.concat(F.lit("h"), F.col("asset_id").cast("string")).alias("sha256"))
    stored = sized.select("asset_id", F.concat(F.lit("h"), (F.col("asset_id") + F.when(F.col("asset_id") % 50 == 1, 1).otherwise(0)).cast("string")).alias("verified_sha256"))
    return quality.asset_relations(users, known, key=["log_id"], role="canonical").unionByName(quality.location_identity(stored, hashes))


@query(
    "meaning_problems",
    """SELECT 'weight is no probability' AS rule, CAST(p_partkey AS VARCHAR) AS key, 'k' || p_size % 4 AS detail FROM part WHERE p_partkey % 3 = 0 AND p_size % 4 IN (0, 1)
UNION ALL SELECT 'usable spectra', CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 10 = 1 THEN 'unconfirmed' ELSE 'verified_sample_major' END FROM part WHERE p_partkey % 3 = 1 AND (p_partkey % 10 = 1 OR p_partkey % 7 = 0)""",
)
def meaning_problems(spark, folder):
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("log_id"), "p_size", F.lit("r").alias("dataset_revision_id"), F.concat(F.lit("k"), (F.col("p_size") % 4).cast("string")).alias("metric_key"))
    logs = part.withColumns(
        {
            "metric_code": F.when(F.col("log_id") % 3 == 0, "mineral_weight").otherwise("other"), "log_kind": F.when(F.col("log_id") % 3 == 1, "spectral").otherwise("scalar"),
            "per_sample_publication_allowed": F.lit(True), "array_layout_status": F.when(F.col("log_id") % 10 == 1, "unconfirmed").otherwise("verified_sample_major"),
        }
    )
    kinds = part.select("dataset_revision_id", "metric_key").distinct()
    metrics = kinds.withColumn("is_probability", F.when(F.col("metric_key") == "k0", F.lit(True)).when(F.col("metric_key") != "k1", F.lit(False)))
    bindings = part.where("log_id % 7 <> 0").select("log_id", F.lit("a").alias("axis_id"), F.lit("verified").alias("status"))
    return quality.weight_not_probability(logs, metrics).unionByName(quality.usable_spectra(logs, bindings))


@query("collar_problems", f"""WITH {SITES_SQL} SELECT 'collar range' AS rule, CAST(hole_id AS VARCHAR) AS key FROM sites WHERE latitude + CASE WHEN hole_id % 9 = 0 THEN 100 ELSE 0 END > 90 OR hole_id % 10 = 7""")
def collar_problems(spark, folder):
    moved = F.col("latitude") + F.when(F.col("hole_id") % 9 == 0, 100).otherwise(0)
    s = sites(spark, folder).withColumns({"latitude": moved, "longitude": F.when(F.col("hole_id") % 10 != 7, F.col("longitude"))})
    return quality.collar_range(s, key=["hole_id"]).select("rule", "key")


@query(
    "orphan_keys",
    """SELECT 'orders -> customer' AS rule, CAST(o_custkey AS VARCHAR) AS key, 'no parent' AS detail FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY'))
UNION ALL SELECT 'lineitem -> part', CAST(l_partkey AS VARCHAR), 'no parent' FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3))""",
)
def orphan_keys(spark, folder):
    tables = {
        "orders": table(spark, folder, "orders"), "lineitem": table(spark, folder, "lineitem"),
        "customer": table(spark, folder, "customer").where("c_mktsegment <> 'MACHINERY'"), "part": table(spark, folder, "part").where("p_size > 3"),
    }
    return quality.foreign_keys(tables, [("orders", ["o_custkey"], "customer", ["c_custkey"]), ("lineitem", ["l_partkey"], "part", ["p_partkey"])])


@query(
    "image_region_problems",
    """WITH r AS (SELECT o_custkey AS f, o_orderkey AS id, o_orderkey % 380 AS x, o_orderkey * 7 % 4000 AS y FROM orders)
SELECT 'region inside frame' AS rule, CAST(id AS VARCHAR) AS key, 'exceeds the frame' AS detail FROM r WHERE x + 50 > 400 OR y + 25 > 4000
UNION ALL SELECT 'regions apart', CAST(a.id AS VARCHAR), 'overlaps ' || count(*) || ' first ' || min(b.id) FROM r a JOIN r b ON a.f = b.f AND a.id <> b.id AND a.x < b.x + 50 AND b.x < a.x + 50 AND a.y < b.y + 25 AND b.y < a.y + 25 GROUP BY a.id
UNION ALL SELECT 'covered once', f || '/' || n, CAST(CASE WHEN f % 9 = 2 AND n = 1 THEN 2 ELSE 0 END AS VARCHAR) FROM (SELECT o_custkey AS f, unnest(range(3 * count(*))) AS n FROM orders GROUP BY 1) WHERE (f % 9 = 1 AND n = 0) OR (f % 9 = 2 AND n = 1)""",
)
def image_region_problems(spark, folder):
    o = table(spark, folder, "orders")
    regions = o.select(F.col("o_custkey").alias("image_frame_id"), F.col("o_orderkey").alias("region_id"), (F.col("o_orderkey") % 380).alias("x"), (F.col("o_orderkey") * 7 % 4000).alias("y"), F.lit(50).alias("width"), F.lit(25).alias("height"))
    frames = o.select(F.col("o_custkey").alias("image_frame_id")).distinct().select("image_frame_id", F.lit(400).alias("width_px"), F.lit(4000).alias("height_px"))
    # three samples to a region, shown by one mapping; on some frames the first is not shown, or the second twice
    counts = o.groupBy(F.col("o_custkey").alias("image_frame_id")).agg((3 * F.count(F.lit(1))).alias("n"))
    frame = F.col("image_frame_id")
    samples = counts.select("image_frame_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("sample_no"))
    mappings = counts.select("image_frame_id", F.when(frame % 9 == 1, 1).otherwise(0).cast("long").alias("sample_no_from"), (F.col("n") - 1).alias("sample_no_to"))
    mappings = mappings.unionByName(counts.where(frame % 9 == 2).select("image_frame_id", F.lit(1).cast("long").alias("sample_no_from"), F.lit(1).cast("long").alias("sample_no_to")))
    return quality.image_regions(regions, frames).unionByName(quality.covered_once(samples, mappings, key=["image_frame_id"]).withColumn("detail", F.col("detail").cast("string")))


@query(
    "spectral_storage_problems",
    """WITH c AS (SELECT l_suppkey AS a, l_linenumber - 1 AS g, count(*) AS n FROM lineitem GROUP BY 1, 2),
r AS (SELECT a, g, n, sum(n) OVER (PARTITION BY a ORDER BY g) - n AS f, sum(n) OVER (PARTITION BY a ORDER BY g) AS t, sum(n) OVER (PARTITION BY a) AS total FROM c)
SELECT 'spectral extent' AS rule, CAST(a AS VARCHAR) AS key FROM (SELECT DISTINCT a FROM r) WHERE a % 8 = 1
UNION ALL SELECT 'spectral block', a || '/' || f FROM r WHERE a % 10 = 3 AND g = 2
UNION ALL SELECT 'spectral block', a || '/' || f FROM r WHERE a % 10 = 3 AND g = 3
UNION ALL SELECT 'spectral map', a || '/' || f FROM r WHERE a % 10 = 3 AND g = 3
UNION ALL SELECT 'spectral map', a || '/' || f FROM r WHERE a % 10 = 3 AND g = 3""",
)
def spectral_storage_problems(spark, folder):
    from stratalog.operators.ordered import ordered_scan, upto

    counts = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("spectral_array_id"), (F.col("l_linenumber") - 1).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    laid = ordered_scan(counts, ["spectral_array_id"], ["g"], {"t": upto("sum", "n")}, block=F.floor(F.col("g") / 65536))
    late = F.when((F.col("spectral_array_id") % 10 == 3) & (F.col("g") == 2), 1).otherwise(0)
    laid = laid.select("spectral_array_id", (F.col("t") - F.col("n")).alias("source_row_from"), (F.col("t") + late).alias("source_row_to_exclusive"), "n")
    arrays = counts.groupBy("spectral_array_id").agg(F.sum("n").alias("sample_count")).withColumns({"sample_stride_bytes": F.lit(256), "data_offset_bytes": F.lit(64), "asset_id": F.col("spectral_array_id")})
    assets = arrays.select("asset_id", (F.col("sample_count") * 256 + 64 + F.when(F.col("asset_id") % 8 == 1, 4).otherwise(0)).alias("byte_size"))
    blocks = laid.withColumns({"byte_offset": F.col("source_row_from") * 256 + 64, "byte_length": F.col("n") * 256})
    maps = laid.select(
        "spectral_array_id", F.lit("a").alias("axis_id"), "source_row_from", (F.col("source_row_to_exclusive") - 1).alias("source_row_to"),
        F.col("source_row_from").alias("sample_no_from"), (F.col("source_row_to_exclusive") - 1).alias("sample_no_to"),
    )
    return quality.all_of([quality.spectral_extent(arrays, assets), quality.spectral_blocks(blocks, arrays), quality.spectral_maps(maps)]).select("rule", "key")


@query(
    "payload_issues",
    """WITH p AS (SELECT p_partkey, p_size, CASE p_partkey % 3 WHEN 0 THEN 'scalar' WHEN 1 THEN 'spectral' ELSE 'profile' END AS kind FROM part)
SELECT 'PAYLOAD_INTEGRITY_FAILURE' AS code, CAST(p_partkey AS VARCHAR) AS scope, 'error' AS severity, 'hash differs from the manifest' AS detail FROM p WHERE p_size % 10 = 1
UNION ALL SELECT 'PAYLOAD_INTEGRITY_FAILURE', CAST(p_partkey AS VARCHAR), 'error', 'non-finite values' FROM p WHERE p_size % 10 = 2
UNION ALL SELECT 'PROFILE_CHANNEL_COUNT_CONFLICT', CAST(p_partkey AS VARCHAR), 'warning', 'declared and observed channels differ' FROM p WHERE kind = 'profile' AND p_size % 2 = 1
UNION ALL SELECT 'SPECTRAL_MATRIX_ORDER_UNCONFIRMED', CAST(p_partkey AS VARCHAR), 'warning', 'row order is not declared by the source' FROM p WHERE kind = 'spectral'""",
)
def payload_issues(spark, folder):
    key = F.col("p_partkey")
    rows = table(spark, folder, "part").select(
        "p_partkey", F.element_at(F.array(F.lit("scalar"), F.lit("spectral"), F.lit("profile")), (key % 3 + 1).cast("int")).alias("kind"), F.lit("a").alias("sha256"),
        F.when(F.col("p_size") % 10 == 1, "b").otherwise("a").alias("expected_sha256"), F.when(F.col("p_size") % 10 == 2, 3).alias("non_finite_count"), F.lit(64).alias("declared_channels"), (F.col("p_size") % 2 + 64).alias("channels"),
    )
    return quality.payload_rules(rows, key=["p_partkey"])


@query(
    "range_read_differences",
    "SELECT o_orderkey, o_totalprice, CAST(1 AS BIGINT) AS surplus FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000 AND o_orderkey % 50 = 0",
)
def range_read_differences(spark, folder):
    source = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return quality.range_read(source, source.where("o_orderkey % 50 <> 0"), at="o_totalprice", start=100000, end=120000, columns=["o_orderkey", "o_totalprice"])


@query(
    "package_problems",
    """WITH p AS (SELECT c_custkey AS k FROM customer)
SELECT 'package identity' AS rule, CAST(k AS VARCHAR) AS key, 'borehole id differs from the folder' AS detail FROM p WHERE k % 11 = 1
UNION ALL SELECT 'package identity', CAST(k AS VARCHAR), 'package incomplete' FROM p WHERE k % 7 = 0
UNION ALL SELECT 'package identity', CAST(k AS VARCHAR), 'no datasets' FROM p WHERE k NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'package identity', CAST(k AS VARCHAR), 'dataset listed twice' FROM p WHERE k % 13 = 2 AND k IN (SELECT o_custkey FROM orders)""",
)
def package_problems(spark, folder):
    counts = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("dataset_count"))
    k = F.col("k")
    holes = table(spark, folder, "customer").select(F.col("c_custkey").alias("k")).join(counts, "k", "left")
    packages = holes.select(
        k.cast("string").alias("hole_id"), (k + F.when(k % 11 == 1, 1).otherwise(0)).cast("string").alias("source_hole_id"), k.cast("string").alias("package_hole_id"),
        F.when(k % 7 == 0, "partial").otherwise("complete").alias("status"), F.lit(0).alias("error_count"), "dataset_count",
        (F.col("dataset_count") - F.when(k % 13 == 2, 1).otherwise(0)).alias("distinct_datasets"), F.lit(0).alias("missing_documents"),
    )
    return quality.package_identity(packages)


@query(
    "report_chain_problems",
    """WITH s AS (SELECT o_custkey AS h, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, o_orderkey FROM orders),
t AS (SELECT h, r AS step, r = 3 AND h % 5 = 0 AS fails, r = 4 AND h % 5 = 1 AS mixed FROM s WHERE NOT (r = 2 AND h % 5 = 2)),
p AS (SELECT *, lag(step) OVER (PARTITION BY h ORDER BY step) AS prev FROM t)
SELECT 'report chain' AS rule, h || '/' || step AS key, CASE WHEN fails THEN 'not passed' WHEN mixed THEN 'versions mixed' ELSE 'step missing' END AS detail
FROM p WHERE fails OR mixed OR (prev IS NOT NULL AND step <> prev + 1)
UNION ALL SELECT 'report chain', o_custkey || '/step/' || o_orderkey, 'artefact changed' FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0""",
)
def report_chain_problems(spark, folder):
    from stratalog.operators.ordered import number, ordered_scan

    numbered = ordered_scan(table(spark, folder, "orders").select(F.col("o_custkey").alias("h"), "o_orderkey"), ["h"], ["o_orderkey"], {"step": number()})
    h, step = F.col("h"), F.col("step")
    steps = numbered.where(~((step == 2) & (h % 5 == 2))).select(
        "h", "step", F.when((step == 3) & (h % 5 == 0), "failed").otherwise("passed").alias("status"), F.when((step == 4) & (h % 5 == 1), "v2").otherwise("v1").alias("version"), (step - 1).alias("previous_step")
    )
    k = F.col("o_orderkey")
    digest = F.sha2(k.cast("string").cast("binary"), 256)
    artefacts = table(spark, folder, "orders").select(F.col("o_custkey").alias("h"), F.concat(F.lit("step/"), k.cast("string")).alias("path"), F.when(k % 89 != 0, digest).alias("sha256"), F.when(k % 97 == 0, F.sha2(digest.cast("binary"), 256)).otherwise(digest).alias("expected_sha256"))
    return quality.report_chain(steps, artefacts, key=["h"])


@query(
    "reference_spectrum_problems",
    "SELECT 'reference spectrum' AS rule, CAST(vec_id AS VARCHAR) AS key, CASE WHEN vec_id % 40 = 0 THEN 'not stored' ELSE 'differs' END AS detail FROM embeddings WHERE vec_id % 40 = 0 OR vec_id % 25 = 3",
)
def reference_spectrum_problems(spark, folder):
    stored = spectra(spark, folder).select("vec_id", "values").where("vec_id % 40 <> 0")
    changed = F.transform("values", lambda v, i: F.when((i == 5) & (F.col("vec_id") % 25 == 3), v + F.lit(0.01).cast("float")).otherwise(v))
    reference = spectra(spark, folder).select("vec_id", changed.alias("values"))
    return quality.reference_spectra(reference, stored, key=["vec_id"])


@query(
    "reference_sample_positions",
    f"""WITH {SCAN_SQL}, a AS (SELECT hole, count(*) AS n, least(4, max(sample_no)) AS e FROM scan GROUP BY 1),
s AS (SELECT hole, n, unnest([0, e, greatest(n // 2 - 1, 0), greatest(n - 2, 0), greatest(least(4095, n - 2), 0)]) AS s FROM a)
SELECT DISTINCT hole, CAST(x AS BIGINT) AS sample_no FROM (SELECT hole, s AS x FROM s UNION ALL SELECT hole, least(s + 1, n - 1) FROM s)""",
)
def reference_sample_positions(spark, folder):
    samples = scan(spark, folder)
    axes = samples.groupBy("hole").agg(F.count(F.lit(1)).alias("sample_count"))
    return quality.reference_positions(axes, ranges(samples, 5, "section"), key=["hole"])


@query(
    "unavailable_profile_problems",
    """SELECT 'unavailable profile' AS rule, 'h/' || p_partkey AS key, 'contradicting payload evidence' AS detail FROM part WHERE p_size % 2 = 0 AND (p_partkey % 5 = 1 OR p_partkey % 7 = 2)""",
)
def unavailable_profile_problems(spark, folder):
    k = F.col("p_partkey")
    manifest = table(spark, folder, "part").select(
        F.lit("h").alias("hole_id"), k.alias("log_id"), F.when(F.col("p_size") % 2 == 0, "unavailable").otherwise("complete").alias("status"), F.concat(F.lit("f"), k.cast("string")).alias("file"),
        F.lit("").alias("sha256"), F.when(k % 5 == 1, 9).otherwise(0).alias("nbytes"), F.lit(0).alias("records"),
    )
    files = manifest.where(F.col("log_id") % 7 == 2).select("hole_id", F.col("file").alias("path"))
    return quality.unavailable_profiles(manifest, files, key=["hole_id"])


@query("loaded_table_differences", """SELECT 'loaded customer' AS rule, CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 31 = 0 THEN 'only left' ELSE 'differs' END AS detail FROM customer WHERE c_custkey % 31 = 0 OR c_custkey % 17 = 4
UNION ALL SELECT 'loaded supplier', CAST(s_suppkey AS VARCHAR), 'differs' FROM supplier WHERE s_suppkey % 9 = 1""")
def loaded_table_differences(spark, folder):
    c, s = table(spark, folder, "customer"), table(spark, folder, "supplier")
    loaded = {
        "customer": c.where("c_custkey % 31 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 17 == 4, F.lit(None)).otherwise(F.col("c_name"))),
        "supplier": s.withColumn("s_acctbal", F.col("s_acctbal") + F.when(F.col("s_suppkey") % 9 == 1, 1.0).otherwise(0.0)),
    }
    return quality.loaded_equals_prepared({"customer": c, "supplier": s}, loaded, {"customer": ["c_custkey"], "supplier": ["s_suppkey"]})


@query(
    "position_log_checks",
    f"""WITH {SCAN_SQL} SELECT hole, CAST(1 AS BIGINT) AS log, count(*) AS samples, CAST(count_if(hole % 3 = 1 AND sample_no % 7 = 0) AS BIGINT) AS nulls, CAST(count_if(hole % 3 = 2 AND sample_no % 9 = 1) AS BIGINT) AS mismatches,
  count_if(hole % 3 = 2 AND sample_no % 9 = 1) = 0 AND count_if(hole % 3 = 1 AND sample_no % 7 = 0) < count(*) AS passed FROM scan GROUP BY 1""",
)
def position_log_checks(spark, folder):
    from stratalog.operators.align import position_log_check

    samples = scan(spark, folder)
    h, s = F.col("hole"), F.col("sample_no")
    expected = samples.select("hole", "sample_no", (s % 10 + 1).alias("tray_sample_no"))
    values = samples.select("hole", "sample_no", F.lit(1).cast("long").alias("log"), F.when((h % 3 == 1) & (s % 7 == 0), "null").when((h % 3 == 2) & (s % 9 == 1), "0").otherwise((s % 10 + 1).cast("string")).alias("value"))
    return position_log_check(values, expected, key=["hole"], log="log", value="value", expected="tray_sample_no", nulls_allowed=True)


@query(
    "profile_minimum_checks",
    f"""WITH {SCAN_SQL} SELECT hole, count(*) AS samples, count(*) AS compared, hole % 2 = 0 OR count_if(k % 10 = 1) = 0 AS passed FROM scan GROUP BY 1""",
)
def profile_minimum_checks(spark, folder):
    from stratalog.operators.align import minima_check

    samples = scan(spark, folder)
    minima = samples.select("hole", "sample_no", F.col("value").alias("positive_min"))
    off = F.when((F.col("hole") % 2 == 1) & (F.col("k") % 10 == 1), 0.01).otherwise(0.00001)
    checked = minima_check(minima, samples.select("hole", "sample_no", (F.col("value") + off).alias("value")), key=["hole"])
    return checked.select("hole", "samples", "compared", "passed")


@query(
    "image_depth_checks",
    f"""WITH {SCAN_SQL}, {INTERVALS_SQL.strip()} SELECT hole, ordinal, CASE WHEN ordinal % 7 = 3 THEN 'no image for this tray' WHEN ordinal % 7 = 5 THEN 'depth bounds differ' ELSE 'decimal' END AS basis, ordinal % 7 NOT IN (3, 5) AS matched FROM tray""",
)
def image_depth_checks(spark, folder):
    from stratalog.operators.align import image_depth_check

    trays = ranges(scan(spark, folder), 10, "tray").select("hole", "ordinal", F.round("depth_min", 4).alias("depth_from_m"), F.round("depth_max", 4).alias("depth_to_m"))
    off = F.when(F.col("ordinal") % 7 == 5, 0.01).otherwise(0.0)
    images = trays.where("ordinal % 7 <> 3").select("hole", "ordinal", "depth_from_m", F.round(F.col("depth_to_m") + off, 4).alias("depth_to_m"))
    return image_depth_check(images, trays, key=["hole"])


@query(
    "image_log_signatures",
    """WITH h AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT k AS hole, 1 + CAST(k % 6 > 0 AND NOT (k % 6 = 3 AND n = 1) AS BIGINT) AS logs, n + CASE WHEN k % 6 = 0 THEN 0 WHEN k % 6 = 3 THEN n - 1 ELSE n END AS images,
  NOT (k % 6 = 2 OR (k % 6 = 3 AND n > 1) OR k % 6 = 4 OR (k % 6 = 5 AND n > 1)) AS identical FROM h""",
)
def image_log_signatures(spark, folder):
    """Image logs of a hole compared by the signature of their whole sequence: equal, shifted, cut short, of other size, in other order."""
    from stratalog.operators.align import sequence_signatures

    holes = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("hole")).agg(F.count(F.lit(1)).alias("n"))
    k, n, i = F.col("hole") % 6, F.col("n"), F.col("i")
    images = holes.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    first = images.select("hole", F.lit("a").alias("log_id"), i.alias("position"), i.alias("ordinal"), F.concat(F.lit("tray/"), i.cast("string"), F.lit(".jpg")).alias("path"), F.lit(640).alias("width"))
    other = images.where((k > 0) & ~((k == 3) & (i == n - 1)))
    shown = F.when((k == 5) & (n > 1), n - 1 - i).otherwise(i)
    second = other.select("hole", F.lit("b").alias("log_id"), i.alias("position"), (i + F.when(k == 2, 1).otherwise(0)).alias("ordinal"), F.concat(F.lit("tray/"), shown.cast("string"), F.lit(".jpg")).alias("path"), F.when((k == 4) & (i == 0), 320).otherwise(640).alias("width"))
    signed = sequence_signatures(first.unionByName(second), key=["hole", "log_id"], ordinal="position", columns=["ordinal", "path", "width"])
    return signed.groupBy("hole").agg(F.count(F.lit(1)).alias("logs"), F.sum("n").alias("images"), (F.count_distinct("digest") == 1).alias("identical"))


@query(
    "image_relation_problems",
    """SELECT 'image relation' AS rule, l_orderkey || '/' || l_linenumber AS key, CASE WHEN p_size % 10 = 3 THEN 'section' ELSE 'tray' END || '/' || CASE WHEN l_suppkey % 8 = 5 THEN 'scalar' ELSE 'image' END AS detail
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size % 10 = 3 OR l_suppkey % 8 = 5 OR l_linenumber = 7""",
)
def image_relation_problems(spark, folder):
    """Every line as an image frame of its part, taken by its supplier's log."""
    parts = table(spark, folder, "part")
    frames = table(spark, folder, "lineitem").join(parts.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select(
        F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("image_frame_id"), F.col("l_partkey").alias("core_interval_id"),
        F.when(F.col("l_linenumber") == 7, "x").otherwise(F.col("p_brand")).alias("source_tray_label"), F.col("l_suppkey").alias("log_id"),
    )
    shown = parts.select(F.col("p_partkey").alias("interval_id"), F.when(F.col("p_size") % 10 == 3, "section").otherwise("tray").alias("interval_kind"), F.col("p_brand").alias("source_label"))
    logs = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("log_id"), F.when(F.col("s_suppkey") % 8 == 5, "scalar").otherwise("image").alias("log_kind"))
    return quality.image_relations(frames, shown, logs)


@query("duplicate_log_aliases", "SELECT source, lang AS name, count(*) AS copies, count(DISTINCT sha256(text)) AS contents, count(DISTINCT sha256(text)) = 1 AS identical FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_log_aliases(spark, folder):
    from stratalog.operators.align import duplicate_alias_check

    docs = table(spark, folder, "documents").select("source", F.col("lang").alias("name"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return duplicate_alias_check(docs, key=["source"], name="name", digest="digest").select("source", "name", "copies", "contents", "identical")


# ---------------------------------------------------------------- routing


def _checked_holes(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("hole_id"), F.when(F.col("c_custkey") % 10 == 0, 2).alias("errors"), F.when(F.col("c_custkey") % 15 == 3, 1).otherwise(0).alias("warnings"))
    counts = table(spark, folder, "orders").where("o_orderkey % 4 = 0").groupBy(F.col("o_custkey").alias("hole_id")).agg(F.count(F.lit(1)).alias("dataset_count"))
    return routing.package_route(c.join(counts, "hole_id", "left"))


ROUTE_SQL = """r AS (
  SELECT c_custkey AS hole_id, n AS dataset_count, CASE WHEN c_custkey % 10 = 0 THEN 'error' WHEN c_custkey % 15 = 3 THEN 'warning' ELSE 'passed' END AS status,
         CASE WHEN c_custkey % 10 = 0 OR c_custkey % 15 = 3 THEN 'attention' WHEN n > 1 THEN 'multi' ELSE 'single' END AS route
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1) ON o_custkey = c_custkey)"""


@query("hole_routes", f"WITH {ROUTE_SQL} SELECT hole_id, dataset_count, status, route FROM r")
def hole_routes(spark, folder):
    return _checked_holes(spark, folder).select("hole_id", "dataset_count", "status", "route")


@query("route_totals", f"WITH {ROUTE_SQL} SELECT route, count(*) AS holes, CAST(sum(coalesce(dataset_count, 0)) AS BIGINT) AS datasets, CAST(count_if(dataset_count IS NULL) AS BIGINT) AS unknown_dataset_count FROM r GROUP BY 1")
def route_totals(spark, folder):
    return routing.route_totals(_checked_holes(spark, folder))


@query("selection_differences", f"WITH {ROUTE_SQL} SELECT c_custkey AS hole_id, CASE WHEN c_custkey % 2 = 0 THEN 'not in group' ELSE 'not selected' END AS side FROM customer JOIN r ON r.hole_id = c_custkey WHERE (c_custkey % 2 = 0) <> (route = 'multi')")
def selection_differences(spark, folder):
    selected = table(spark, folder, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("hole_id"))
    return routing.selection_difference(selected, _checked_holes(spark, folder), "multi")


@query(
    "special_case_routing",
    """WITH e AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer),
d AS (SELECT k, list_sort(list_filter([CASE WHEN n = 1 THEN '12' END, CASE WHEN n <> 1 AND k % 6 = 0 THEN '01' END, CASE WHEN n NOT IN (1, 2) AND n = 3 THEN '02' END, CASE WHEN n NOT IN (1, 2) AND k % 4 = 1 THEN '05' END,
   CASE WHEN n NOT IN (1, 2) AND k % 9 = 2 THEN '09' END, CASE WHEN n = 2 AND k % 2 = 0 THEN '11' END], lambda x: x IS NOT NULL)) AS cases,
   n = 2 AND k % 2 = 1 AS multi_open, n NOT IN (1, 2) AND k % 8 = 5 AS reset_open, k % 12 = 7 AS broken FROM e)
SELECT k AS hole_id, array_to_string(cases, ',') AS cases, CASE WHEN multi_open OR reset_open OR broken OR len(cases) = 0 THEN 'needs_review' ELSE 'routed' END AS status,
 CASE WHEN NOT (multi_open OR reset_open OR broken OR len(cases) = 0) THEN CASE WHEN list_contains(cases, '12') THEN '12' WHEN list_contains(cases, '11') THEN '11' ELSE coalesce(list_filter(cases, lambda x: x <> '01')[1], '01') END END AS assigned_case FROM d""",
)
def special_case_routing(spark, folder):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    none = F.lit(None).cast("string")
    evidence = table(spark, folder, "customer").select(
        k.alias("key"), F.when(n == 1, "12").alias("plan"), F.when(k % 6 == 0, F.concat(F.lit("a b"), k.cast("string"))).otherwise(k.cast("string")).alias("hole_id"), F.lit(False).alias("has_identity_file"),
        F.when(n == 2, 2).otherwise(1).alias("dataset_count"), F.when(k % 2 == 0, 1).otherwise(2).alias("distinct_sample_counts"), F.lit(False).alias("membership_failure"),
        F.when(n == 3, "tray_local").otherwise("equal").alias("virtual_section"), F.lit(0).alias("literal_text_errors"), F.when(k % 4 == 1, 5).otherwise(0).alias("profile_nulls"), F.lit("ok").alias("profile_reference"),
        F.lit("none").alias("interval_aliases"), F.lit("single").alias("image_logs"), F.lit(0).alias("float32_bounds"), F.lit(0).alias("wide_bounds"), F.when(k % 8 == 5, "other").otherwise("none").alias("resets"),
        F.lit("none").alias("unavailable_profile"), F.lit("unasked").alias("profile_float32"), F.when(k % 9 == 2, 1).otherwise(0).alias("unknown_axes"),
        F.when(k % 12 == 7, "PermissionError: x").otherwise(none).alias("message"), F.lit(0).alias("unexplained_payload_errors"), F.array().cast("array<string>").alias("applied_cases"),
    )
    routed = routing.assign_case(routing.case_evidence(evidence))
    return routed.select(F.col("key").alias("hole_id"), F.array_join("cases", ",").alias("cases"), "status", "assigned_case")


def case_sources(spark, folder):
    """Source tables of one hole per order with as many samples as it has lines; every kind of fault on some of them."""
    holes = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    k, n = F.col("k"), F.col("n")
    named = F.when(k % 43 == 2, F.concat(F.lit("a b"), k.cast("string"))).otherwise(k.cast("string"))
    holes = settle_table(holes.withColumn("hole_id", named), "case-holes")
    i = F.col("sample_no")

    def depth(at):
        fallen = ((k % 11 == 3) & (at >= 3)) | ((k % 11 == 4) & (at >= 1))
        return 1_000_000.0 + at - F.when(fallen, 10.0).otherwise(0.0)

    samples = holes.withColumn("sample_no", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("depth", depth(i))
    tray = F.expr("sample_no div 3")
    # three samples to a tray, the last one shorter: no sample is moved to find them
    trays = holes.withColumn("tray_no", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div 3")))).withColumn("lo", (F.col("tray_no") * 3).cast("int"))
    trays = trays.withColumn("hi", F.least(F.col("lo") + 2, n - 1)).withColumns({"top": depth(F.col("lo")), "bottom": depth(F.col("hi"))})
    section = F.when(k % 7 == 0, i % 3 + 1).when((k % 7 == 1) & (i == 0), None).when((k % 7 == 2) & (k % 3 == 0) & (i == n - 1), i + 2).otherwise(i + 1)
    reference = F.when((k % 5 == 1) & (i == 0), "null").when((k % 5 == 2) & (k % 4 == 0) & (i == 0), "inf").otherwise((F.col("depth") + 0.5).cast("string"))
    values = samples.select("hole_id", F.lit("v").alias("log_id"), F.lit("virtual_section").alias("log_name"), "sample_no", F.coalesce(section.cast("string"), F.lit("")).alias("value"))
    values = values.unionByName(samples.select("hole_id", F.lit("p").alias("log_id"), F.lit("prof_min").alias("log_name"), "sample_no", reference.alias("value")))
    logs = [("t", "Tray", "a", F.lit(True)), ("s", "Section", "b", F.lit(True)), ("t2", "Tray", "a", k % 13 == 1), ("s2", "Section", "c", k % 13 == 2)]
    logs = F.array(*[F.when(there, F.struct(*[F.lit(v).alias(c) for v, c in zip(log, ("log_id", "log_name", "sha256"))])) for *log, there in logs])
    logs = holes.select("hole_id", F.explode(logs).alias("log")).where("log is not null").select("hole_id", "log.*")
    image = F.struct(F.lit("i1").alias("log_id"), F.lit(1).alias("copy"))
    second = F.when((k % 17).isin(1, 2, 4) | ((k % 17 == 3) & (F.col("hi") < n - 1)), F.struct(F.lit("i2").alias("log_id"), F.lit(2).alias("copy")))
    third = F.when((k % 17 == 4) & (F.col("tray_no") == 0), F.struct(F.lit("i2").alias("log_id"), F.lit(3).alias("copy")))
    images = trays.withColumn("image", F.explode(F.array(image, second, third))).where("image is not null").select(
        "hole_id", "image.log_id", k.alias("dataset_id"), F.col("tray_no").alias("sample_no"),
        (F.col("top") + F.when(k % 19 == 1, 0.02).when(k % 19 == 2, 1.0).otherwise(0.0)).alias("depth_from"), F.col("bottom").alias("depth_to"), F.col("top").alias("start_value"), F.col("bottom").alias("end_value"),
        F.when((k % 17 == 2) & (F.col("image.copy") == 2) & (F.col("tray_no") == 0), "x").otherwise(F.col("tray_no").cast("string")).alias("sha256"),
    )
    reviewed = holes.where("k % 11 = 3 and k % 2 = 1").select("hole_id", F.lit(3).alias("sample_no")).unionByName(holes.where("k % 11 = 4").select("hole_id", F.lit(1).alias("sample_no")))
    minimum = F.col("depth") + 0.5 + F.when((k % 3 == 0) & (i == n - 1), 1.0).otherwise(0.0)
    message = F.when(k % 47 == 1, "Profile positive minima differ").when(k % 47 == 2, "SpectralLogCollection").when(k % 47 == 3, "PermissionError: x")
    return {
        "holes": holes.select("hole_id", "k", F.when(k % 41 == 1, "12").when(k % 41 == 2, "13").alias("plan"), (k % 43 == 1).alias("has_identity_file")),
        "datasets": holes.select("hole_id", F.explode(F.when(k % 37 == 1, F.array(n, n)).when(k % 37 == 2, F.array(n, n + 1)).otherwise(F.array(n))).alias("samples")),
        "sections": samples.select("hole_id", (i + 1).alias("section_no"), tray.alias("tray_no"), i.alias("lo"), i.alias("hi")),
        "trays": trays.select("hole_id", "tray_no", "lo", "hi"), "logs": logs, "values": values, "images": images, "reviewed_resets": reviewed,
        "positions": samples.select("hole_id", "sample_no", "depth"), "minima": samples.select("hole_id", "sample_no", minimum.alias("minimum")),
        "text_rows": holes.select("hole_id", F.lit("x").alias("log_id"), F.explode(F.array(F.array(*[F.lit("0")] * 3), F.when(k % 29 == 1, F.array(*[F.lit("0")] * 4)).otherwise(F.array(*[F.lit("0")] * 3)))).alias("fields")),
        "profiles": holes.select("hole_id", F.when(k % 23 <= 2, "unavailable").otherwise("available").alias("status"), F.lit("").alias("sha256"), F.lit(0).alias("nbytes"), F.when(k % 23 == 2, 3).otherwise(0).alias("records"), (k % 23 == 0).alias("file_there")),
        "spectra": holes.select("hole_id", F.when(k % 31 == 1, F.array(F.lit(400.0), F.lit(2500.0))).otherwise(F.array(F.lit(380.0), F.lit(1000.0), F.lit(2500.0))).alias("wavelengths"), F.when(k % 31 == 2, "um").otherwise("nm").alias("unit")),
        "failures": holes.select("hole_id", message.alias("message"), F.when(k % 53 == 1, 2).otherwise(0).alias("unexplained_payload_errors"), F.when(k % 59 == 1, F.array(F.lit("01"))).alias("applied_cases")),
    }


@query(
    "special_cases_from_sources",
    """WITH h AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
e AS (SELECT *, k % 41 IN (1, 2) AS planned, k % 37 IN (1, 2) AS multi, k % 37 = 1 OR k % 47 = 2 AS known,
  CASE WHEN k % 7 = 0 AND n > 3 THEN 'tray_local' WHEN k % 7 = 1 THEN CASE WHEN n = 1 THEN 'other' ELSE 'nulls' END WHEN k % 7 = 2 AND k % 3 = 0 THEN 'other' ELSE 'equal' END AS vs,
  (k % 5 = 1 AND n = 1) OR (k % 5 = 2 AND k % 4 = 0) AS invalid,
  CASE WHEN k % 11 = 3 AND n > 3 THEN CASE WHEN k % 2 = 1 THEN 'reviewed' ELSE 'other' END WHEN k % 11 = 4 AND n > 1 THEN 'other' ELSE 'none' END AS resets,
  CASE WHEN k % 17 = 1 THEN 'identical' WHEN k % 17 IN (2, 4) OR (k % 17 = 3 AND n > 3) THEN 'different' ELSE 'single' END AS images FROM h),
f AS (SELECT *, NOT planned AND NOT multi AS single, k % 47 = 1 AND NOT (invalid OR k % 3 = 0) AS minima FROM e),
c AS (SELECT *, list_sort(list_filter([CASE WHEN k % 41 = 1 THEN '12' WHEN k % 41 = 2 THEN '13' END, CASE WHEN NOT planned AND k % 43 IN (1, 2) THEN '01' END, CASE WHEN single AND vs = 'tray_local' THEN '02' END,
   CASE WHEN single AND k % 13 = 1 THEN '03' END, CASE WHEN single AND images = 'identical' THEN '04' END, CASE WHEN single AND (vs = 'nulls' OR (k % 5 = 1 AND NOT invalid)) THEN '05' END,
   CASE WHEN single AND (k % 19 = 1 OR minima) THEN '06' END, CASE WHEN single AND resets = 'reviewed' THEN '07' END, CASE WHEN single AND k % 29 = 1 THEN '08' END, CASE WHEN single AND k % 31 IN (1, 2) THEN '09' END,
   CASE WHEN single AND k % 23 = 1 THEN '10' END, CASE WHEN NOT planned AND multi AND known THEN '11' END], lambda x: x IS NOT NULL)) AS cases,
  CAST(NOT planned AND multi AND NOT known AS INT) + CAST(single AND vs = 'other' AS INT) + CAST(single AND invalid AS INT) + CAST(single AND k % 13 = 2 AS INT) + CAST(single AND images = 'different' AS INT)
   + CAST(single AND k % 19 = 2 AS INT) + CAST(single AND resets = 'other' AS INT) + CAST(single AND k % 23 IN (0, 2) AS INT) + CAST(single AND k % 47 = 1 AND NOT minima AS INT) + CAST(k % 53 = 1 AS INT) + CAST(k % 47 = 3 AS INT) AS held FROM f),
d AS (SELECT *, held + CAST(len(cases) = 0 AS INT) + CAST(k % 59 = 1 AND len(list_filter(cases, lambda x: x <> '01')) = 0 AS INT) AS unresolved FROM c)
SELECT k AS hole_id, array_to_string(cases, ',') AS cases, unresolved, CASE WHEN unresolved > 0 THEN 'needs_review' ELSE 'routed' END AS status,
 CASE WHEN unresolved = 0 THEN CASE WHEN list_contains(cases, '13') THEN '13' WHEN list_contains(cases, '12') THEN '12' WHEN list_contains(cases, '11') THEN '11' ELSE coalesce(list_filter(cases, lambda x: x <> '01')[1], '01') END END AS assigned_case FROM d""",
)
def special_cases_from_sources(spark, folder):
    sources = case_sources(spark, folder)
    routed = routing.assign_case(routing.case_evidence(evidence.hole_evidence(sources)))
    keys = sources["holes"].select("hole_id", "k")
    return routed.join(keys, "hole_id").select(F.col("k").alias("hole_id"), F.array_join("cases", ",").alias("cases"), F.size("unresolved").alias("unresolved"), "status", "assigned_case")


@query(
    "cuttings_selection",
    """WITH d AS (SELECT o_custkey AS hole_id, o_orderkey AS dataset_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey || '_Cuttings2' ELSE CAST(o_custkey AS VARCHAR) END AS dataset_name FROM orders),
h AS (SELECT hole_id, count_if(dataset_id % 3 = 0) AS c, count_if(dataset_id % 3 <> 0) AS r FROM d GROUP BY 1)
SELECT CAST(d.hole_id AS VARCHAR) AS hole_id, dataset_id, dataset_id % 3 <> 0 AS kept, CASE WHEN r > 1 THEN 'the remaining datasets need review' END AS problem FROM d JOIN h ON h.hole_id = d.hole_id WHERE c > 0""",
)
def cuttings_selection(spark, folder):
    name = F.col("o_custkey").cast("string")
    datasets = table(spark, folder, "orders").select(
        name.alias("hole_id"), F.col("o_orderkey").alias("dataset_id"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(name, F.lit("_Cuttings2"))).otherwise(name).alias("dataset_name")
    )
    return routing.core_datasets(datasets).select("hole_id", "dataset_id", "kept", "problem")


@query(
    "split_hole_outputs",
    f"""WITH {SITES_SQL}
SELECT CAST(hole_id AS VARCHAR) AS hole_id, hole_id || '-site' AS split_hole, round(longitude + CASE WHEN hole_id % 8 = 4 THEN 0.01 ELSE 0 END, 6) AS x,
  CASE WHEN hole_id % 6 = 0 THEN 'project differs' WHEN hole_id % 8 = 4 THEN 'override inconsistent with the site' END AS problem FROM sites WHERE hole_id % 2 = 0""",
)
def split_hole_outputs(spark, folder):
    s = sites(spark, folder)
    k = F.col("hole_id")
    datasets = s.select(k.cast("string").alias("hole_id"), k.alias("dataset_id"), F.col("hole_name").alias("dataset_name"), F.col("longitude").cast("string").alias("longitude"), F.col("latitude").cast("string").alias("latitude"), "project")
    reviewed = s.where("hole_id % 2 = 0").select(
        k.cast("string").alias("hole_id"), k.alias("dataset_id"), F.when(k % 6 == 0, "other").otherwise(F.col("project")).alias("project"), F.lit("site").alias("label"),
        F.when(k % 8 == 4, F.col("longitude") + 0.01).alias("override_x"), F.when(k % 8 == 4, F.col("latitude")).alias("override_y"),
    )
    return routing.split_holes(datasets, reviewed).select("hole_id", "split_hole", F.round("x", 6).alias("x"), "problem")


@query(
    "own_datasets",
    f"""WITH {SITES_SQL},
d AS (SELECT o_custkey AS h, o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'x' || o_orderkey END AS name, latitude + (o_orderkey % 3) * 0.004 AS lat, longitude AS lon FROM orders JOIN sites ON hole_id = o_custkey),
z AS (SELECT h, count(*) AS n, count_if(name = CAST(h AS VARCHAR)) AS named FROM d GROUP BY 1),
a AS (SELECT DISTINCT h, lat AS alat, lon AS alon FROM d WHERE name = CAST(h AS VARCHAR) UNION SELECT z.h, latitude, longitude FROM z JOIN sites ON hole_id = z.h WHERE named = 0),
near AS (SELECT DISTINCT d.h, id FROM d JOIN a ON a.h = d.h WHERE {km_sql("lat", "lon", "alat", "alon", 6371.0)} <= 0.5)
SELECT CAST(d.h AS VARCHAR) AS hole_id, d.id AS dataset_id FROM d JOIN z ON z.h = d.h LEFT JOIN near ON near.h = d.h AND near.id = d.id WHERE d.name = CAST(d.h AS VARCHAR) OR (named = 0 AND n = 1) OR near.id IS NOT NULL""",
)
def own_datasets(spark, folder):
    s = sites(spark, folder)
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("hole_id"), F.col("o_orderkey").alias("dataset_id"))
    text = F.col("hole_id").cast("string")
    datasets = o.join(s.select("hole_id", "latitude", "longitude"), "hole_id").select(
        text.alias("hole_id"), "dataset_id", F.when(F.col("dataset_id") % 4 == 0, text).otherwise(F.concat(F.lit("x"), F.col("dataset_id").cast("string"))).alias("dataset_name"),
        (F.col("latitude") + (F.col("dataset_id") % 3) * 0.004).alias("latitude"), "longitude",
    )
    holes = s.select(text.alias("hole_id"), "latitude", "longitude")
    return routing.own_datasets(datasets, holes).select("hole_id", "dataset_id")


@query(
    "dataset_choices",
    f"""WITH {SITES_SQL},
d AS (SELECT o_custkey AS h, o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE latitude + (o_orderkey % 3 - 1) * 0.5 END AS lat, longitude AS lon, latitude, longitude, o_orderkey % 50 AS span FROM orders JOIN sites ON hole_id = o_custkey),
g AS (SELECT *, {km_sql("lat", "lon", "latitude", "longitude", 6371.0)} AS km FROM d),
p AS (SELECT *, CASE WHEN lat IS NULL THEN 1 WHEN km <= 0.5 THEN 0 ELSE 2 END AS place FROM g)
SELECT h AS hole_id, id AS dataset_id, ['at collar', 'unknown', 'elsewhere'][place + 1] AS place,
 row_number() OVER (PARTITION BY h ORDER BY place, CASE WHEN place = 2 THEN round(km, 6) ELSE 0 END, -span, id) AS choice FROM p""",
)
def dataset_choices(spark, folder):
    s = sites(spark, folder).select("hole_id", "latitude", "longitude")
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("hole_id"), F.col("o_orderkey").alias("dataset_id"), F.col("o_orderkey").alias("position"), F.lit(0.0).alias("depth_from_m"), (F.col("o_orderkey") % 50).cast("double").alias("depth_to_m"))
    place = F.col("dataset_id") % 3
    datasets = o.join(s, "hole_id").withColumn("latitude", F.when(place != 0, F.col("latitude") + (place - 1) * 0.5))
    return routing.choose_dataset(datasets, s).select("hole_id", "dataset_id", "place", "choice")


@query(
    "isolated_holes",
    """WITH v AS (SELECT o_custkey AS h, count(*) AS n, min((o_orderpriority, o_orderstatus)) AS f FROM orders WHERE o_totalprice > 490000 GROUP BY 1)
SELECT c_custkey AS hole_id, CASE WHEN n IS NULL THEN 'passed' ELSE 'failed' END AS status, coalesce(n, 0) AS problems, CASE WHEN n IS NULL THEN '' ELSE f[1] || ': ' || f[2] END AS first_problem FROM customer LEFT JOIN v ON h = c_custkey""",
)
def isolated_holes(spark, folder):
    holes = table(spark, folder, "customer").select(F.col("c_custkey").alias("hole_id"))
    bad = table(spark, folder, "orders").where("o_totalprice > 490000").select(F.col("o_custkey").alias("hole_id"), F.col("o_orderpriority").alias("rule"), F.col("o_orderstatus").alias("detail"))
    return routing.isolate(holes, bad)[1]


@query(
    "retry_plan",
    """WITH a AS (SELECT o_custkey AS h, arg_max(o_orderkey, o_orderkey) AS last FROM orders GROUP BY 1)
SELECT h AS hole_id, '05' AS new_cases, CASE WHEN last % 3 = 0 THEN '02,05' ELSE '05' END AS cases FROM a WHERE last % 2 = 0 AND last % 3 <> 1""",
)
def retry_plan(spark, folder):
    k = F.col("o_orderkey")
    attempts = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("hole_id"), k.alias("attempt"), F.when(k % 2 == 0, "failed").otherwise("passed").alias("status"),
        F.when(k % 3 == 0, F.array(F.lit("02"))).when(k % 3 == 1, F.array(F.lit("05"))).otherwise(F.array().cast("array<string>")).alias("cases"),
    )
    diagnoses = table(spark, folder, "customer").select(F.col("c_custkey").alias("hole_id"), F.lit("routed").alias("status"), F.array(F.lit("05")).alias("cases"))
    plan = routing.retry_plan(attempts, diagnoses)
    return plan.select("hole_id", F.array_join("new_cases", ",").alias("new_cases"), F.array_join("cases", ",").alias("cases"))


@query(
    "ineligible_holes",
    """WITH s AS (SELECT l_orderkey AS h, count(*) AS n FROM lineitem GROUP BY 1)
SELECT h AS hole_id, CASE WHEN n > 1 THEN 'selected twice' WHEN h % 5 = 0 THEN 'not diagnosed' WHEN h % 5 = 1 THEN 'has not failed' ELSE 'assigned to another case' END AS problem FROM s WHERE n > 1 OR h % 5 IN (0, 1, 2)""",
)
def ineligible_holes(spark, folder):
    selected = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("hole_id"))
    k = F.col("o_orderkey")
    diagnoses = table(spark, folder, "orders").where("o_orderkey % 5 <> 0").select(
        k.alias("hole_id"), F.lit("routed").alias("status"), F.when(k % 5 == 2, "03").otherwise("02").alias("assigned_case"), F.when(k % 5 == 1, "passed").otherwise("failed").alias("failure_status")
    )
    return routing.eligible(selected, diagnoses, "02")


@query("complete_holes", "SELECT c_custkey AS hole_id FROM customer WHERE c_custkey % 3 > 0 AND c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 3)")
def complete_holes(spark, folder):
    states = table(spark, folder, "customer").select(F.col("c_custkey").alias("hole_id"), F.when(F.col("c_custkey") % 3 > 0, "complete").otherwise("failed").alias("status"))
    outputs = table(spark, folder, "orders").select(F.col("o_custkey").alias("hole_id"), F.col("o_orderstatus").alias("folder"))
    return routing.present_outputs(states, outputs, ["F", "O", "P"]).select("hole_id")


@query("photo_provenance", f"""WITH {SITES_SQL}, d AS (SELECT o_custkey AS h, o_orderkey AS id FROM orders)
SELECT h AS hole_id, CASE WHEN id % 5 = 0 THEN CAST(h AS VARCHAR) ELSE 'd' || id END AS dataset_name, CASE WHEN id % 5 = 0 THEN 'named' WHEN id % 5 = 1 THEN 'no collar' WHEN id % 5 = 2 THEN 'near' ELSE 'elsewhere' END AS verdict, id % 5 IN (0, 2) AS belongs FROM d JOIN sites ON hole_id = h""")
def photo_provenance(spark, folder):
    from stratalog.operators.geometry import photo_provenance as provenance

    s = sites(spark, folder)
    k = F.col("o_orderkey") % 5
    o = table(spark, folder, "orders").join(s, F.col("hole_id") == F.col("o_custkey"))
    sources = o.select(
        F.col("hole_id").cast("string").alias("hole_id"), F.when(k == 0, F.col("hole_id").cast("string")).otherwise(F.concat(F.lit("d"), F.col("o_orderkey").cast("string"))).alias("dataset_name"),
        F.when(k != 1, F.col("latitude") + F.when(k == 2, 0.001).otherwise(1.0)).alias("collar_lat"), F.when(k != 1, F.col("longitude")).alias("collar_lon"),
    )
    found = provenance(s.select(F.col("hole_id").cast("string").alias("hole_id"), "latitude", "longitude"), sources)
    return found.select(F.col("hole_id").cast("long").alias("hole_id"), "dataset_name", "verdict", "belongs")


# ---------------------------------------------------------------- publication


@query(
    "release_identities",
    f"""WITH {MEMBERS_SQL}, m AS (SELECT c_nationkey AS nation, dataset_id, dataset_revision_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY dataset_id) - 1 AS p FROM base JOIN customer ON c_custkey = dataset_id),
l0 AS (SELECT nation, p, sha256('{{"dataset_id":' || dataset_id || ',"dataset_revision_id":' || dataset_revision_id || '}}') AS h FROM m),
l1 AS (SELECT nation, p // 4096 AS p, count(*) AS n, sha256(string_agg(p || ':' || h, chr(10) ORDER BY p)) AS h FROM l0 GROUP BY 1, 2),
l2 AS (SELECT nation, p // 4096 AS p, sum(n) AS n, sha256(string_agg(p || ':' || h, chr(10) ORDER BY p)) AS h FROM l1 GROUP BY 1, 2),
l3 AS (SELECT nation, p // 4096 AS p, sum(n) AS n, sha256(string_agg(p || ':' || h, chr(10) ORDER BY p)) AS h FROM l2 GROUP BY 1, 2),
d AS (SELECT nation, CAST(sum(n) AS BIGINT) AS n, sha256(sha256(string_agg(p || ':' || h, chr(10) ORDER BY p)) || '|flow') AS m FROM l3 GROUP BY 1),
i AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('release:' || m)) AS h FROM d)
SELECT nation, n, m AS manifest_sha256, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS release_id FROM i""",
)
def release_identities(spark, folder):
    base, _ = members(spark, folder)
    nations = table(spark, folder, "customer").select(F.col("c_custkey").alias("dataset_id"), F.col("c_nationkey").alias("nation"))
    return release.release_identity(base.join(nations, "dataset_id"), prefix="release", metadata="flow", by=["nation"])


@query(
    "unvalidated_members",
    f"""WITH {MEMBERS_SQL} SELECT dataset_id, dataset_revision_id, CASE WHEN dataset_id % 9 = 0 THEN 'not validated' WHEN dataset_id % 9 = 1 THEN 'validation failed' ELSE 'content changed since validation' END AS problem FROM incoming WHERE dataset_id % 9 < 3""",
)
def unvalidated_members(spark, folder):
    _, incoming = members(spark, folder)
    k = F.col("dataset_id")
    digest = F.sha2(F.col("dataset_revision_id").cast("string"), 256)
    checks = incoming.where("dataset_id % 9 <> 0").select("dataset_revision_id", F.when(k % 9 == 2, F.lit("old")).otherwise(digest).alias("input_digest"), F.when(k % 9 == 1, "failed").otherwise("passed").alias("status"))
    return release.unvalidated(incoming.withColumn("input_digest", digest), checks)


@query("unready_members", f"""WITH {MEMBERS_SQL} SELECT dataset_id, dataset_revision_id, 'asset not located' AS problem FROM incoming WHERE dataset_id % 12 = 5""")
def unready_members(spark, folder):
    _, incoming = members(spark, folder)
    digest = F.sha2(F.col("dataset_revision_id").cast("string"), 256)
    listed = incoming.withColumn("input_digest", digest)
    checks = listed.select("dataset_revision_id", "input_digest", F.lit("passed").alias("status"))
    assets = listed.select("dataset_revision_id", F.col("dataset_id").alias("asset_id"), F.col("input_digest").alias("sha256"))
    stored = assets.select("asset_id", F.when(F.col("asset_id") % 12 == 5, "x").otherwise(F.col("sha256")).alias("verified_sha256"), F.lit("verified_remote").alias("access_status"))
    return release.unready(listed, checks, assets, stored)


@query("load_plan", f"WITH {MEMBERS_SQL} SELECT dataset_id, CASE WHEN dataset_id NOT IN (SELECT dataset_id FROM base) THEN 'load' WHEN dataset_id % 6 = 1 THEN 'conflict' ELSE 'skip' END AS action FROM incoming")
def load_plan(spark, folder):
    base, incoming = members(spark, folder)
    existing = base.select("dataset_id", F.lit("d").alias("input_digest"))
    fresh = incoming.select("dataset_id", F.when(F.col("dataset_id") % 6 == 1, "other").otherwise("d").alias("input_digest"))
    return release.plan_load(existing, fresh, ident="dataset_id")


@query("reusable_outputs", "SELECT l_suppkey AS hole_id, CAST(count(DISTINCT l_linenumber) FILTER (l_suppkey % 4 = 0 AND l_linenumber = 3) AS BIGINT) AS changed, count(DISTINCT l_linenumber) FILTER (l_suppkey % 4 = 0 AND l_linenumber = 3) = 0 AS reusable FROM lineitem GROUP BY 1")
def reusable_outputs(spark, folder):
    files = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("hole_id"), F.col("l_linenumber").alias("path")).distinct().withColumn("sha256", F.lit("a"))
    now = files.withColumn("sha256", F.when((F.col("hole_id") % 4 == 0) & (F.col("path") == 3), "b").otherwise("a"))
    return release.reusable(files, now)


@query("rows_to_insert", "SELECT s_suppkey + 1 AS id, s_name AS name FROM supplier WHERE s_suppkey + 1 NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def rows_to_insert(spark, folder):
    target = table(spark, folder, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    fresh = table(spark, folder, "supplier").select((F.col("s_suppkey") + 1).alias("id"), F.col("s_name").alias("name"))
    return release.insert_missing(target, fresh, key=["id"])[0]


@query(
    "carried_segments",
    f"""WITH {MEMBERS_SQL},
m AS (SELECT * FROM base WHERE dataset_id NOT IN (SELECT dataset_id FROM incoming WHERE dataset_id % 2 = 0) UNION ALL SELECT * FROM incoming WHERE dataset_id % 2 = 0),
g AS (SELECT m.*, m.dataset_id // 2 AS hole FROM m), c AS (SELECT hole, count(*) AS n FROM g GROUP BY 1)
SELECT g.hole AS borehole_id, g.dataset_id, g.dataset_revision_id, CASE WHEN EXISTS (SELECT 1 FROM g x LEFT JOIN base b ON b.dataset_id = x.dataset_id AND b.dataset_revision_id = x.dataset_revision_id WHERE x.hole = g.hole AND b.dataset_id IS NULL)
   OR (SELECT count(*) FROM base b WHERE b.dataset_id // 2 = g.hole) <> c.n THEN 'default' ELSE 'carried' END AS origin
FROM g JOIN c ON c.hole = g.hole
WHERE c.n = 1 OR NOT (EXISTS (SELECT 1 FROM g x LEFT JOIN base b ON b.dataset_id = x.dataset_id AND b.dataset_revision_id = x.dataset_revision_id WHERE x.hole = g.hole AND b.dataset_id IS NULL)
   OR (SELECT count(*) FROM base b WHERE b.dataset_id // 2 = g.hole) <> c.n)""",
)
def carried_segments(spark, folder):
    base, incoming = members(spark, folder)
    kept, _ = release.accumulate(base, incoming.where("dataset_id % 2 = 0"))
    hole = F.floor(F.col("dataset_id") / 2).alias("borehole_id")
    now = kept.select(hole, "dataset_id", F.col("dataset_revision_id").cast("string").alias("dataset_revision_id"))
    segments = base.select(
        F.lit(1).alias("source_no"), hole, (F.col("dataset_id") % 2).cast("int").alias("sequence_no"), "dataset_id", F.col("dataset_revision_id").cast("string").alias("dataset_revision_id"),
        F.lit("a").alias("axis_id"), F.lit(0.0).alias("selection_from_md_m"), F.lit(9.0).alias("selection_to_md_m"), F.lit(True).alias("upper_inclusive"),
        F.lit(0).cast("long").alias("sample_no_from"), F.lit(8).cast("long").alias("sample_no_to"), F.lit("selected").alias("selection_status"),
    )
    axes = now.select("dataset_revision_id", F.lit("a").alias("axis_id"), F.lit(9).cast("long").alias("sample_count"), F.lit(0.0).alias("depth_min_m"), F.lit(9.0).alias("depth_max_m"))
    found, _ = release.carry_segments(now, segments, axes)
    return found.select("borehole_id", "dataset_id", F.col("dataset_revision_id").cast("long").alias("dataset_revision_id"), F.when(F.col("source_no").isNull(), "default").otherwise("carried").alias("origin"))


@query(
    "final_selection_problems",
    """SELECT c_custkey AS dataset_id, CASE WHEN c_custkey % 10 = 0 THEN 'unknown dataset' WHEN c_custkey % 10 = 1 THEN 'left out without saying so' ELSE 'listed as omitted but not omitted' END AS problem FROM customer WHERE c_custkey % 10 IN (0, 1, 3)""",
)
def final_selection_problems(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("dataset_id"))
    return release.final_selection(c.where("dataset_id % 10 <> 0"), c.where("dataset_id % 10 not in (1, 2)"), c.where("dataset_id % 10 in (2, 3)"))


@query("batch_scope_differences", "SELECT c_nationkey AS hole_id, c_custkey AS dataset_id, CASE WHEN c_custkey % 5 = 0 THEN 'missing from batch' ELSE 'not in release' END AS side FROM customer WHERE c_nationkey < 10 AND (c_custkey % 5 = 0 OR c_custkey % 5 = 1)")
def batch_scope_differences(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_nationkey").alias("hole_id"), F.col("c_custkey").alias("dataset_id"))
    return release.batch_scope(c.where("dataset_id % 5 <> 1"), c.where("hole_id < 10 and dataset_id % 5 <> 0"))


@query("collapsed_assets", "SELECT sha256(text) AS sha256, min(doc_id) AS asset_id, count(*) AS copies, min(n_chars) AS byte_size, min(lang) AS media_type FROM documents GROUP BY 1 HAVING min(lang) = max(lang) AND min(n_chars) = max(n_chars)")
def collapsed_assets(spark, folder):
    docs = table(spark, folder, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("doc_id").alias("asset_id"), F.col("n_chars").alias("byte_size"), F.col("lang").alias("media_type"))
    return release.collapse_assets(docs)[0]


@query(
    "acceptance_problems",
    """SELECT c_custkey AS dataset_id, 'not in second stage' AS problem FROM customer WHERE c_custkey % 20 = 4
UNION ALL SELECT c_custkey, 'content differs in first stage' FROM customer WHERE c_custkey % 20 = 7
UNION ALL SELECT c_custkey, 'in two first-stage reports' FROM customer WHERE c_custkey % 20 = 9""",
)
def acceptance_problems(spark, folder):
    k = F.col("dataset_id")
    wanted = table(spark, folder, "customer").select(F.col("c_custkey").alias("dataset_id"), F.lit("d").alias("input_digest"))
    first = wanted.select("dataset_id", F.when(k % 20 == 7, "x").otherwise("d").alias("input_digest"), F.lit("passed").alias("status"), F.lit("r1").alias("report_id"))
    again = first.where("dataset_id % 20 = 9").withColumn("report_id", F.lit("r2"))
    second = first.where("dataset_id % 20 <> 4").withColumn("input_digest", F.lit("d")).drop("report_id")
    return release.acceptance_problems(wanted, first.unionByName(again), second)


@query("display_identities", """WITH l0 AS (SELECT o_custkey AS h, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p, o_orderkey FROM orders),
a AS (SELECT h, p, sha256('{"dataset_id":' || o_orderkey || ',"sequence_no":' || p || '}') AS x FROM l0),
l1 AS (SELECT h, p // 4096 AS p, sha256(string_agg(p || ':' || x, chr(10) ORDER BY p)) AS x, count(*) AS n FROM a GROUP BY 1, 2),
l2 AS (SELECT h, p // 4096 AS p, sha256(string_agg(p || ':' || x, chr(10) ORDER BY p)) AS x, sum(n) AS n FROM l1 GROUP BY 1, 2),
l3 AS (SELECT h, p // 4096 AS p, sha256(string_agg(p || ':' || x, chr(10) ORDER BY p)) AS x, sum(n) AS n FROM l2 GROUP BY 1, 2)
SELECT h AS borehole_id, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(p || ':' || x, chr(10) ORDER BY p)) AS digest FROM l3 GROUP BY 1""")
def display_identities(spark, folder):
    from stratalog.operators.ordered import number, ordered_scan

    parts = ordered_scan(table(spark, folder, "orders").select(F.col("o_custkey").alias("h"), "o_orderkey", F.rand(1).alias("release_id")), ["h"], ["o_orderkey"], {"sequence_no": number()})
    parts = parts.select(F.col("h").alias("borehole_id"), F.col("o_orderkey").alias("dataset_id"), (F.col("sequence_no") - 1).alias("sequence_no"), "release_id")
    return release.display_identity(parts.select("dataset_id", "sequence_no", "release_id", "borehole_id").withColumnRenamed("borehole_id", "hole"), hole="hole", volatile=("release_id", "hole")).withColumnRenamed("hole", "borehole_id")


@query(
    "removable_assets",
    """WITH a AS (SELECT l_partkey AS k, bool_or(l_linenumber = 7) AS e, bool_or(l_linenumber = 6) AS r, bool_and(l_linenumber < 5) AS c FROM lineitem GROUP BY 1),
u AS (SELECT DISTINCT l_partkey AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' AND l_quantity > 48),
j AS (SELECT a.k, CASE WHEN e THEN 'evidence' WHEN r THEN 'raw' WHEN c THEN 'canonical' ELSE 'unknown' END AS kind, u.k IS NOT NULL AS used FROM a LEFT JOIN u ON u.k = a.k)
SELECT k AS object_key, kind, CASE WHEN used THEN 'referenced by an incomplete batch' WHEN kind IN ('evidence', 'unknown') THEN 'evidence or unknown kind' WHEN kind = 'raw' THEN 'raw source' END AS kept_because FROM j""",
)
def removable_assets(spark, folder):
    items = table(spark, folder, "lineitem")
    role = F.when(F.col("l_linenumber") == 7, "evidence").when(F.col("l_linenumber") == 6, "raw").when(F.col("l_linenumber") < 5, "canonical").otherwise("other")
    assets = items.select(F.col("l_partkey").alias("object_key"), role.alias("role"))
    references = items.where("l_quantity > 48").select(F.col("l_partkey").alias("object_key"), F.col("l_orderkey").alias("batch_id"))
    batches = table(spark, folder, "orders").select(F.col("o_orderkey").alias("batch_id"), (F.col("o_orderstatus") != "P").alias("complete"))
    return release.removable_assets(assets, references, batches)


CHAIN_SQL = """ax AS (SELECT o_custkey AS hole, o_orderpriority AS ds, min(CAST(o_orderdate AS DATE) - DATE '1990-01-01') AS lo, max(CAST(o_orderdate AS DATE) - DATE '1990-01-01') AS hi FROM orders GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY hole ORDER BY lo, ds) - 1 AS seq, lead(lo) OVER (PARTITION BY hole ORDER BY lo, ds) AS cut FROM ax),
p AS (SELECT hole, ds, seq, lo AS f, CASE WHEN cut IS NULL THEN hi ELSE least(hi, cut) END AS t, coalesce(hi < cut, TRUE) AS inc FROM w)"""


def _chain(spark, folder):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("hole"), F.col("o_orderpriority").alias("ds"), day.alias("md_m"), F.col("o_orderkey").alias("sample_no"))
    axes = orders.groupBy("hole", "ds").agg(F.min("md_m").alias("depth_min_m"), F.max("md_m").alias("depth_max_m"))
    return orders, release.succession(axes, hole=["hole"], order=["depth_min_m", "ds"])


@query("succession_windows", f"WITH {CHAIN_SQL} SELECT hole, ds, seq AS sequence_no, f AS selection_from_md_m, t AS selection_to_md_m, inc AS upper_inclusive FROM p")
def succession_windows(spark, folder):
    _, parts = _chain(spark, folder)
    return parts.select("hole", "ds", "sequence_no", "selection_from_md_m", "selection_to_md_m", "upper_inclusive")


@query(
    "window_sample_ranges",
    f"""WITH {CHAIN_SQL}, o AS (SELECT o_custkey AS hole, o_orderpriority AS ds, o_orderkey AS s, CAST(o_orderdate AS DATE) - DATE '1990-01-01' AS d FROM orders)
SELECT p.hole, p.seq AS sequence_no, min(s) AS sample_no_from, max(s) AS sample_no_to, CASE WHEN count(s) > 0 THEN 'selected' ELSE 'fully_superseded' END AS selection_status
FROM p LEFT JOIN o ON o.hole = p.hole AND o.ds = p.ds AND d >= f AND (d < t OR (inc AND d = t)) GROUP BY 1, 2""",
)
def window_sample_ranges(spark, folder):
    orders, parts = _chain(spark, folder)
    axis = F.concat_ws("/", F.col("hole").cast("string"), F.col("ds"))
    found = release.selected_parts(
        parts.select(F.col("hole").alias("composite_id"), "sequence_no", axis.alias("axis_id"), "selection_from_md_m", "selection_to_md_m", "upper_inclusive"),
        orders.select(axis.alias("axis_id"), "sample_no", "md_m"),
    )
    return found.select(F.col("composite_id").alias("hole"), "sequence_no", "sample_no_from", "sample_no_to", "selection_status")


@query(
    "composite_window_problems",
    f"""WITH {CHAIN_SQL}, o AS (SELECT o_custkey AS hole, o_orderpriority AS ds, o_orderkey AS s, CAST(o_orderdate AS DATE) - DATE '1990-01-01' AS d FROM orders),
x AS (SELECT p.hole, p.seq, min(s) AS a, max(s) AS b, count(s) AS n FROM p LEFT JOIN o ON o.hole = p.hole AND o.ds = p.ds AND d >= f AND (d < t OR (inc AND d = t)) GROUP BY 1, 2)
SELECT 'composite window' AS rule, hole || '/' || seq AS key, 'samples differ from the window' AS detail FROM x WHERE (hole % 20 = 3 AND n > 0) OR (n > 0 AND n <> b - a + 1)""",
)
def composite_window_problems(spark, folder):
    orders, parts = _chain(spark, folder)
    axis = F.concat_ws("/", F.col("hole").cast("string"), F.col("ds"))
    samples = orders.select(axis.alias("axis_id"), "sample_no", "md_m")
    chosen = release.selected_parts(
        parts.select(F.col("hole").alias("composite_id"), "sequence_no", axis.alias("axis_id"), "selection_from_md_m", "selection_to_md_m", "upper_inclusive"), samples
    )
    wrong = chosen.withColumn("sample_no_to", F.col("sample_no_to") + F.when(F.col("composite_id") % 20 == 3, 1).otherwise(0))
    return quality.composite_windows(wrong, samples)


@query(
    "composite_samples",
    f"""WITH {SCAN_SQL} SELECT hole, sample_no, CASE WHEN sample_no < 20 THEN 0 ELSE 1 END AS sequence_no FROM scan WHERE sample_no < 20 OR (sample_no BETWEEN 30 AND 60)""",
)
def composite_samples(spark, folder):
    samples = scan(spark, folder).select(F.col("hole").alias("axis_id"), "sample_no")
    holes = samples.select("axis_id").distinct()
    part = lambda no, a, b: holes.select(F.col("axis_id").alias("composite_id"), F.lit(no).alias("sequence_no"), F.lit("r").alias("dataset_revision_id"), "axis_id", F.lit(a).alias("sample_no_from"), F.lit(b).alias("sample_no_to"), F.lit("selected").alias("selection_status"))
    found = release.composite_samples(part(0, 0, 19).unionByName(part(1, 30, 60)), samples)
    return found.select(F.col("axis_id").alias("hole"), "sample_no", "sequence_no")


@query("published_release", f"WITH {MEMBERS_SQL} SELECT dataset_id, dataset_revision_id FROM base WHERE dataset_id NOT IN (SELECT dataset_id FROM incoming) UNION ALL SELECT * FROM incoming")
def published_release(spark, folder):
    """Two releases published one after the other; the members of the active one."""
    from stratalog.session import scratch

    root = scratch(spark, "release")
    base, incoming = members(spark, folder)
    later, _ = release.accumulate(base, incoming)
    previous = None
    for name, chosen in (("first", base), ("second", later)):
        listed = chosen.withColumn("input_digest", F.sha2(F.col("dataset_revision_id").cast("string"), 256))
        checks = listed.select("dataset_revision_id", "input_digest", F.lit("passed").alias("status"))
        release.publish(spark, root, listed, checks, name, previous)
        previous = name
    return release.release_members(spark, root).select("dataset_id", "dataset_revision_id")


@query(
    "final_revision_ids",
    f"""WITH {SCAN_SQL},
l0 AS (SELECT hole, sample_no AS p, sha256('{{"event_id":' || event_id || ',"us":' || us || '}}') AS h FROM scan),
l1 AS (SELECT hole, p // 4096 AS p, count(*) AS n, sha256(string_agg(p || ':' || h, chr(10) ORDER BY p)) AS h FROM l0 GROUP BY 1, 2),
l2 AS (SELECT hole, p // 4096 AS p, sum(n) AS n, sha256(string_agg(p || ':' || h, chr(10) ORDER BY p)) AS h FROM l1 GROUP BY 1, 2),
l3 AS (SELECT hole, p // 4096 AS p, sum(n) AS n, sha256(string_agg(p || ':' || h, chr(10) ORDER BY p)) AS h FROM l2 GROUP BY 1, 2),
d AS (SELECT hole, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(p || ':' || h, chr(10) ORDER BY p)) AS digest FROM l3 GROUP BY 1),
i AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('revision:' || hole || ':' || digest)) AS h FROM d)
SELECT hole, n, digest, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS revision_id FROM i""",
)
def final_revision_ids(spark, folder):
    return release.revision_identity(scan(spark, folder), prefix="revision", by=["hole"], position="sample_no", columns=["event_id", "us"])


@query("daily_calls_kept", f"WITH {DAILY_SQL} SELECT hole, depth_from_m, call FROM daily WHERE hole IN (SELECT c_custkey FROM customer)")
def daily_calls_kept(spark, folder):
    from stratalog.operators.relations import semi

    known = sites(spark, folder).select(F.col("hole_id").alias("hole"))
    return semi(daily(spark, folder), known, ["hole"]).select("hole", "depth_from_m", "call")


@query(
    "strict_field_checks",
    """WITH t AS (SELECT c_custkey, c_custkey % 5 AS k FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS flag, k = 3 AS odd_flag,
  CASE k WHEN 0 THEN '2024-02-29' WHEN 4 THEN '2024-01-02T03:04:05' END AS day, k = 3 AS broken_day,
  k IN (0, 2) AS safe_key, CASE k WHEN 0 THEN 'Illite' WHEN 1 THEN 'Mica' WHEN 2 THEN 'Chlorite' END AS class, k IN (0, 3, 4) AS rising
FROM t""",
)
def strict_field_checks(spark, folder):
    """Strict booleans, ISO dates, object keys, class codes and rising axes, each with values that fail."""
    k = F.col("c_custkey") % 5
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    axis = F.element_at(F.array(*[F.array(*[F.lit(x).cast("double") for x in a]) for a in ([1, 2, 3], [1, 1], [2, 1, 3], [5], [])]), (k + 1).cast("int"))
    rows = table(spark, folder, "customer").select(
        "c_custkey", pick("true", "false", "", "yes", None).alias("flag"), pick("2024-02-29", "unknown", "", "2024-02-30", "2024-01-02T03:04:05").alias("day"),
        pick("a/b.parquet", "../a", "a/..b", "/a", "c:/a").alias("key"), pick("2", "1.0", " Chlorite ", "9", "").alias("class"), axis.alias("axis"),
        F.array(F.lit("Mica"), F.lit("Illite")).alias("classes"),
    )
    return rows.select(
        "c_custkey", text.strict_boolean("flag").alias("flag"), F.coalesce(text.unknown_boolean("flag"), F.lit(False)).alias("odd_flag"),
        text.iso_date("day").alias("day"), F.coalesce(text.broken_date("day"), F.lit(False)).alias("broken_day"), text.safe_object_key("key").alias("safe_key"),
        text.class_name("class", "classes").alias("class"), numbers.strictly_increasing("axis").alias("rising"),
    )
