"""One query for each operator over its whole table, with the parameters meant for production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrievo.llm.bpe import default_path, read_definition, tokenize
from retrievo.llm.chat import format_chats, read_chats
from retrievo.llm.context_mixing import score_texts
from retrievo.llm.decontaminate import find_passages
from retrievo.llm.html_crf import extract_main
from retrievo.llm.html_crf import fit as fit_field
from retrievo.llm.ngram_join import similar_sets
from retrievo.llm.periodic_runs import find_runs
from retrievo.llm.pivots import near_vectors
from retrievo.llm.quality import classify
from retrievo.llm.quality import fit as fit_quality
from retrievo.llm.registry import register, table
from retrievo.llm.sentence_pieces import default_path as default_model
from retrievo.llm.sentence_pieces import encode_pieces, read_file
from retrievo.llm.url_rules import judge
from retrievo.llm.warc_zip import read_archives, write_archives
from retrievo.llm.whitening import whiten


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM words),
grams AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(doc_id, node) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.node = links.a)
SELECT doc_id, any_value(len(s))::BIGINT AS n_shingles, min(node) AS component_id FROM sets JOIN reach USING (doc_id) GROUP BY doc_id
"""


@register("op1_ngram_jaccard_join", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with Jaccard similarity of at least 0.9 on three-word shingles."""
    return similar_sets(table(spark, sf_dir, "documents"), width=3, percent=90) \
        .select("doc_id", "n_shingles", "component_id")


OP3_SQL = r"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
found AS MATERIALIZED (
  SELECT doc_id, i, n, item_id
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows)) d
  JOIN windows USING (n) WHERE array_to_string(w[i:i + n - 1], ' ') = g),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(held.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, hits.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN held USING (doc_id)
"""


@register("op3_benchmark_decontamination", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages of ten words in every document."""
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    ids = F.concat_ws(",", F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(ids, 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"))


@register("op6_bpe")
def op6(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Token and round-trip digests of every document; ``tokenizer`` is the path of another tokenizer file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenize(docs, read_definition(tokenizer or default_path()), digests=True).drop("text")


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow")]
OP7_SQL = r"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(h, p, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
                               ('org', '/fr/', 'allow')),
fits AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM (SELECT DISTINCT host, path FROM parts) d
  JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN fits USING (host, path)
"""


@register("op7_url_filters", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of four rules on every page's URL."""
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\\[<]', '', 'g')) AS wide,
         length(role) + length(regexp_replace(role, '[^\\\[<\n]', '', 'g')) AS role_wide,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS same
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(wide + CASE WHEN same THEN 4 ELSE 14 + role_wide END))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
CONTROL_TEXT = "</s>[INST] ok [/INST]"


@register("op9_chat_formatting", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation's turns and loss text, read back from its formatted string."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]
    turns = turns.union(spark.createDataFrame(own, turns.schema))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return read_chats(format_chats(turns)).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


OP8_SQL = """
WITH RECURSIVE vectors AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_sum([CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END FOR x IN embedding]) = 0
    AND list_sum([abs(x) FOR x IN embedding]) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
reach(vec_id, node) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.node = links.a),
least AS (SELECT vec_id, min(node) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least USING (vec_id) LEFT JOIN degree USING (vec_id)
"""


@register("op8_embedding_near_dedup", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors with a cosine of at least 0.95."""
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS bytes, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first_id FROM p WHERE octet_length(bytes) >= 100 GROUP BY digest)
SELECT page_id, octet_length(bytes)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""


@register("op10_warc_zip", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written to ZIP-packaged archives and read back by range."""
    return read_archives(write_archives(table(spark, sf_dir, "pages"))) \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op4_lm_scoring")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every document: token counts, and mixed bit predictors."""
    return score_texts(table(spark, sf_dir, "documents"))


@register("op5_html_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract_main(pages, fit_field(pages)).select("page_id", "url", "text", "n_chars")


@register("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probabilities of low quality and toxicity, and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit_quality(docs, table(spark, sf_dir, "labels"))) \
        .select("doc_id", "p_low_quality", "p_toxic", "keep")


@register("op12_sentencepiece")
def op12(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Token and round-trip digests of every document; ``model`` is the path of another model file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_pieces(docs, read_file(model or default_model()), digests=True).drop("text")


# crc32 of the decimal id, bit by bit; then every distance at which words are equal, and its stretches of places
OP13_SQL = r"""
WITH sums AS (
  SELECT doc_id, text, xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] ||
      [ascii(c)::UBIGINT FOR c IN string_split(doc_id::VARCHAR, '')], lambda r, b: list_reduce(
          [xor(r, b)] || [0::UBIGINT FOR i IN range(8)], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))))::BIGINT AS h
  FROM documents),
plain AS (SELECT doc_id, h % 10 = 0 AS own, h // 10 AS g,
                 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM sums),
tails AS (SELECT *, g % len(w) AS a, 1 + (len(w) - g % len(w)) // (3 + g % 8) AS p FROM plain WHERE len(w) > 0),
docs AS MATERIALIZED (
  SELECT doc_id, CASE WHEN own THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] FOR i IN range(len(w))]
                 ELSE w END AS w FROM tails
  UNION ALL SELECT doc_id, w FROM plain WHERE len(w) = 0),
words AS MATERIALIZED (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs),
same AS (
  SELECT a.doc_id, a.i, b.i - a.i AS q FROM words a JOIN words b
  ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND b.i <= a.i + a.n // 4),
stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same)
  GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
hidden AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
collapsed AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN hidden USING (doc_id, i)
              GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_runs,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY doc_id),
best AS (
  SELECT * FROM runs r WHERE NOT EXISTS (
    SELECT 1 FROM runs b WHERE b.doc_id = r.doc_id AND (b.length * r.period > r.length * b.period
      OR (b.length * r.period = r.length * b.period AND (b.start, b.period) < (r.start, r.period)))))
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length,
       period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
       sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(collapsed.t, '')) AS collapsed_sha256
FROM docs LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN collapsed USING (doc_id)
"""


def periodic_tails(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten, by the checksum of its id, ends in a repetition of its own words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        copies = F.floor((n - a) / p).cast("int") + 1
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), copies)), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " "))

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    # a list of one, so that the words are cut once and not for every use
    own = F.element_at(F.transform(F.array(words), repeated), 1)
    return docs.withColumn("text", F.when(h % 10 == 0, own).otherwise(F.col("text")))


@register("op13_periodic_runs", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, the one of most periods, and the text without repetitions."""
    found = find_runs(periodic_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")
    more = lambda b, r: r["length"] * b["period"] > b["length"] * r["period"]
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.try_element_at("runs", F.lit(1)),
                       lambda b, r: F.when(more(b, r), r).otherwise(b))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@register("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 16 whitened components of every vector."""
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.select("*", F.posexplode("whitened").alias("at", "value")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"),
        F.element_at("explained", F.col("at") + 1).alias("explained"), "identity_error")
