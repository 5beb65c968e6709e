"""The registered queries of this subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import bpe, burst_trie, chat, decontamination, lsh_forest, mixing, passages, pstable, quality_rules, shards, urls, warc, whitening
from stratalog.plans.registry import query
from stratalog.session import scratch, table

WORD = r"[^\x20\x09-\x0D]+"


@query("op1_substring_dedup")
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(table(spark, folder, "documents"))


WARC_SQL = """
WITH records AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
sized AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM records),
firsts AS (SELECT payload_digest, min(page_id) AS first_id FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM sized LEFT JOIN firsts USING (payload_digest)
"""


@query("op2_warc_packages", WARC_SQL)
def warc_packages(spark: SparkSession, folder: str) -> DataFrame:
    """What is read back: sizes and digests of responses are those of the bytes read, a revisit states its own."""
    pages = table(spark, folder, "pages").select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    manifest = warc.write_archives(warc.record_types(pages), scratch(spark, "warc"))
    read = warc.read_records(warc.index_archives(manifest))
    response = F.col("record_type") == "response"
    return read.select(
        "page_id",
        F.when(response, F.length("payload").cast("long")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


@query("op3_minhash_near_dedup")
def minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, folder, "documents"), n=4, similar=80)


EMBEDDING_SQL = """
WITH RECURSIVE numbered AS (SELECT vec_id, embedding, row_number() OVER () AS r FROM embeddings),
vectors AS (SELECT r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM numbered WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.r AS a, b.r AS b, b.vec_id AS other_id FROM vectors a JOIN vectors b ON a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(node, other, other_id) AS (SELECT a, b, other_id FROM pairs UNION SELECT r.node, p.b, p.other_id FROM reach r JOIN pairs p ON r.other = p.a),
smallest AS (SELECT node, min(other_id) AS other FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(other, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(other, vec_id)) AS kept
FROM numbered LEFT JOIN counts ON a = r LEFT JOIN smallest ON node = r
"""


@query("op4_embedding_near_dedup", EMBEDDING_SQL)
def embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return pstable.near_duplicates(table(spark, folder, "embeddings"), least=0.9)


@query("op5_byte_level_bpe")
def byte_level_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = bpe.encode(table(spark, folder, "documents"), keep=["doc_id"])
    ids = F.col("token_ids")
    digests = bpe.decode(encoded.select("doc_id", "token_ids"))
    return digests.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op6_training_order_shards")
def training_order_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every sequence as it is read back from its shard, with the documents it came from."""
    manifest = shards.write_shards(table(spark, folder, "documents"), scratch(spark, "shards"))
    read = shards.read_shards(manifest)
    digests = read.select(F.col("slot").alias("_slot"), F.col("n_tokens").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))
    return manifest.select("slot", "shard", "offset", "doc_ids").join(digests, F.col("slot") == F.col("_slot")).select("slot", "shard", "offset", "n_tokens", "ids_sha256", "doc_ids")


URL_RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]


@query("op7_url_filters")
def url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """The urls that a rule decides are the labelled table for all others."""
    parsed = table(spark, folder, "pages").select("page_id", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    rule, verdict = urls.longest_rule(F.col("host"), F.col("path"), URL_RULES)
    ruled = parsed.withColumn("rule", rule).withColumn("ruled", verdict)
    model = urls.train(ruled.where("rule is not null").withColumn("label", (F.col("ruled") == "block").cast("int")))
    judged = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return urls.score(ruled, model).select("page_id", "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), "block_probability")


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Ids that every label calls good and none toxic."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0").select("doc_id")


@query("op8_quality_rules")
def quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = quality_rules.fit(documents, trusted_documents(table(spark, folder, "labels")))
    return quality_rules.judge(documents, model, keep=["doc_id"])


MIX_SQL = rf"""
WITH sizes AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
units AS (SELECT doc_id, source, size, count(*) AS n FROM sizes GROUP BY ALL),
totals AS (SELECT source, CAST(sum(size * n) AS BIGINT) AS source_size FROM units GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {mixing.WEIGHTS} + 1 AS w, source_size * {mixing.MOST} AS cap FROM totals),
levels AS (
  SELECT *, CAST(cap AS DOUBLE) / w AS ratio,
    CAST((SELECT sum(source_size) FROM totals) - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, ratio <= level AS capped,
    CASE WHEN ratio <= level THEN CAST(cap AS DOUBLE) ELSE max(CASE WHEN ratio > level THEN level END) OVER () * w END AS target,
    CAST(('0x' || substr(md5('{mixing.SEED}:' || coalesce('1' || source, '0')), 1, 8)) AS UBIGINT) / 4294967296.0::DOUBLE AS shift
  FROM levels),
rated AS (SELECT *, CASE WHEN capped THEN {mixing.MOST}.0::DOUBLE ELSE target / source_size END AS rate FROM targets),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY size, doc_id) - n AS before FROM units WHERE size > 0),
placed AS (SELECT *, before + unnest(range(1, CAST(n AS BIGINT) + 1)) AS r FROM ranked),
drawn AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
    floor(t.rate) + floor(t.shift + k.r * (t.rate - floor(t.rate))) - floor(t.shift + (k.r - 1) * (t.rate - floor(t.rate))) AS copies
  FROM placed k JOIN rated t ON k.source IS NOT DISTINCT FROM t.source
  UNION ALL SELECT u.doc_id, u.size, t.source_size, t.target, 0 FROM (SELECT *, unnest(range(CAST(n AS BIGINT))) FROM units WHERE size = 0) u JOIN rated t ON u.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM drawn
"""


@query("op9_source_mixing", MIX_SQL)
def source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    sized = table(spark, folder, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.copies(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
marked AS (
  SELECT *, '<|im_start|>' || regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') || chr(10)
    || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10) AS formatted
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, formatted)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, formatted) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query("op10_chat_formatting", CHAT_SQL)
def chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    says = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    turns = turns.withColumn("parts", chat.text_parts(F.col("text")))
    return chat.conversation_digests(chat.format_turns(turns))


TRIE_SQL = """
WITH texts AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM texts),
counts AS (SELECT conv_id, max(place) AS n FROM turns GROUP BY conv_id),
bits AS (SELECT conv_id, n, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda i: CAST((ord(c) >> i) & 1 AS BIGINT)))) AS b FROM counts),
crc AS (SELECT conv_id, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295::BIGINT) % 6 AS h FROM bits),
wanted AS (SELECT c.*, c.conv_id - c.conv_id % 100 AS base, least(h, coalesce(b.n, 0)) AS taken FROM crc c LEFT JOIN counts b ON b.conv_id = c.conv_id - c.conv_id % 100),
rebuilt AS (
  SELECT w.conv_id, t.place, t.role, t.text FROM wanted w JOIN turns t ON t.conv_id = w.base AND t.place <= w.h
  UNION ALL SELECT w.conv_id, t.place - w.h + w.taken, t.role, t.text FROM wanted w JOIN turns t ON t.conv_id = w.conv_id AND t.place > w.h),
steps AS (SELECT conv_id, place, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text) AS step, length(text) AS chars FROM rebuilt),
prefixes AS (
  SELECT conv_id, place AS depth, chars, list(step) OVER (PARTITION BY conv_id ORDER BY place) AS path, place = count(*) OVER (PARTITION BY conv_id) AS ends FROM steps
  UNION ALL SELECT conv_id, 0, 0, [], conv_id NOT IN (SELECT conv_id FROM steps) FROM wanted),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS gain,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256, count(*) FILTER (WHERE ends) AS n_ends
  FROM prefixes GROUP BY path, depth),
families AS (SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.path[:n.depth] = n.path) AS n_children FROM nodes n),
lines AS (SELECT path[:d] AS path, d AS depth, gain, CAST(n_children = 0 AS INTEGER) AS leaf FROM (SELECT *, unnest(range(depth + 1)) AS d FROM families)),
sums AS (SELECT path, depth, sum(leaf) AS n_leaves, sum(gain) AS saved_tokens FROM lines GROUP BY path, depth)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.n_ends, f.ends_sha256
FROM families f JOIN sums s ON s.path = f.path AND s.depth = f.depth LEFT JOIN nodes p ON p.depth = f.depth - 1 AND p.path = f.path[:f.depth - 1] AND f.depth > 0
"""


@query("op11_conversation_trie", TRIE_SQL)
def conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns, lengths = burst_trie.with_shared_openings(burst_trie.numbered_turns(table(spark, folder, "conversations")))
    return burst_trie.trie(turns, lengths)


LEAKS_SQL = r"""
WITH worded AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
runs AS (SELECT r, s, size, array_to_string(w[s : s + size - 1], ' ') AS win FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM worded, sizes WHERE len(w) >= size)),
met AS (SELECT r, s, x.size, item_id FROM runs x JOIN windows i ON x.win = i.win AND x.size = i.size),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS p FROM (SELECT DISTINCT r, s, size FROM met)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM met WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM worded LEFT JOIN hits USING (r) LEFT JOIN found USING (r)
"""


@query("op12_benchmark_decontamination", LEAKS_SQL)
def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op13_embedding_whitening")
def embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    embeddings = table(spark, folder, "embeddings")
    model = whitening.fit(embeddings)
    whitened = whitening.apply(embeddings, model)
    explained = F.array(*[F.lit(share).cast("double") for share in (model.explained() if model else [])]).cast("array<double>")
    error = F.lit(whitening.identity_error(whitened, model)).cast("double")
    each = whitened.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), error.alias("identity_error"))
