"""Queries over the text functions and document parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from retrievo.functions import formats, keywords, text
from retrievo.operators import documents
from retrievo.plans import derived as d, sqltext as q
from retrievo.plans.registry import register, table

# words of the test languages stand in for domain terms and stop words
DOMAIN = ("tion", "mente", "heit", "eaux")
STOP = ("the", "and", "with", "die", "der", "und", "les", "des", "que", "los", "las", "con")


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _strip(expr):
    return f"regexp_replace({expr}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


def _blank(expr):
    return f"regexp_replace({expr}, '\\s+', '', 'g') = ''"


@register("clean_text", f"""
SELECT doc_id, md5(c) AS clean_md5, length(c) AS n FROM (SELECT doc_id, {q.clean('text')} AS c FROM documents)""")
def clean_text(spark, sf_dir):
    c = text.clean_text(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", c.alias("c")).select(
        "doc_id", F.md5(F.col("c").cast("binary")).alias("clean_md5"), F.length("c").alias("n"))


@register("token_stats", f"""
WITH t AS (SELECT doc_id, {q.tokens('text')} AS toks FROM documents)
SELECT doc_id, len(toks) AS n_tokens, len(list_distinct(toks)) AS n_terms, md5(array_to_string(toks, ' ')) AS tokens_md5
FROM t""")
def token_stats(spark, sf_dir):
    t = docs(spark, sf_dir).select("doc_id", text.bm25_tokenize(F.col("text")).alias("toks"))
    return t.select("doc_id", F.size("toks").alias("n_tokens"), F.size(F.array_distinct("toks")).alias("n_terms"),
                    F.md5(F.array_join("toks", " ").cast("binary")).alias("tokens_md5"))


@register("query_keywords", f"""
SELECT conv_id, turn, array_to_string({q.keywords('text', 8, DOMAIN, STOP)}, '|') AS keywords FROM conversations""")
def query_keywords(spark, sf_dir):
    kw = keywords.extract_keywords(F.col("text"), 8, DOMAIN, STOP)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(kw, "|").alias("keywords"))


@register("memory_keywords", f"""
WITH parts AS (SELECT conv_id, turn, unnest(list_transform(string_split_regex(text,
    '\\s+|[,，。！？、】【；;：“”"''（）()]'), lambda p: {_strip('p')})) AS p FROM conversations),
kw AS (SELECT conv_id, turn, p AS k FROM parts WHERE length(p) >= 2
  UNION SELECT conv_id, turn, unnest(list_concat({q.windows('p', 2)}, {q.windows('p', 3)}, {q.windows('p', 4)}))
  FROM parts WHERE length(p) >= 4)
SELECT conv_id, turn, count(k) AS n, md5(string_agg(k, '|' ORDER BY k COLLATE "C")) AS keywords_md5
FROM kw GROUP BY conv_id, turn""".replace(' COLLATE "C"', ""))
def memory_keywords(spark, sf_dir):
    kw = F.sort_array(text.memory_keywords(F.col("text")))
    return (table(spark, sf_dir, "conversations").select("conv_id", "turn", kw.alias("kw"))
            .filter(F.size("kw") > 0)
            .select("conv_id", "turn", F.size("kw").cast("long").alias("n"),
                    F.md5(F.array_join("kw", "|").cast("binary")).alias("keywords_md5")))


@register("keyword_coverage", f"""
WITH q AS (SELECT conv_id, text, {q.keywords('text', 8, DOMAIN, STOP)} AS kw FROM conversations WHERE turn = 0),
a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
m AS (SELECT conv_id, turn, kw, list_filter(kw, lambda k: contains(lower(a.text), lower(k))) AS hit
  FROM a JOIN q USING (conv_id))
SELECT conv_id, turn, array_to_string(hit, '|') AS matched, len(kw) - len(hit) AS n_missing,
  round(CASE WHEN len(kw) > 0 THEN len(hit) / len(kw) ELSE 0 END, 6) AS coverage, len(hit) > 0 AS any_match FROM m""")
def keyword_coverage(spark, sf_dir):
    """How well each answer covers the keywords of its conversation's first message."""
    conv = table(spark, sf_dir, "conversations")
    asked = conv.filter("turn = 0").select("conv_id", keywords.extract_keywords(F.col("text"), 8, DOMAIN, STOP)
                                           .alias("kw"))
    answers = conv.filter("role = 'assistant'").join(asked, "conv_id")
    kw, body = F.col("kw"), F.col("text")
    return answers.select(
        "conv_id", "turn", F.array_join(keywords.matched(kw, body), "|").alias("matched"),
        F.size(keywords.missing(kw, body)).cast("long").alias("n_missing"),
        F.round(keywords.coverage(kw, body), 6).alias("coverage"), keywords.contains_any(body, kw).alias("any_match"))


_KINDS = ("faq", "dialogue", "article", "csv")


def _format_sql(expr: str, ignore_rules: bool = False) -> str:
    sig = (f"list_filter(list_transform(string_split({expr}, chr(10)), lambda x: {_strip('x')}), "
           "lambda x: x <> '' AND NOT starts_with(x, '===')"
           + (" AND x <> '---'" if ignore_rules else "") + ")")
    share = lambda cond: f"len(list_filter(sig, lambda x: {cond})) / len(sig)"
    return f"""(SELECT CASE WHEN len(sig) = 0 THEN 'PLAIN' WHEN f >= 0.5 THEN 'FAQ' WHEN c >= 0.5 THEN 'CONVERSATION'
  WHEN a >= 0.5 THEN 'ARTICLE' WHEN v >= 0.5 THEN 'CSV'
  WHEN (f > 0.1)::INT + (c > 0.1)::INT + (a > 0.1)::INT + (v > 0.1)::INT >= 2 THEN 'MIXED' ELSE 'PLAIN' END
  FROM (SELECT sig, {share("starts_with(x, 'Q:') OR starts_with(x, 'Q：')")} AS f,
    {share("starts_with(x, 'User:') OR starts_with(x, '用户：') OR starts_with(x, '顾客：') OR starts_with(x, '客户：')")} AS c,
    {share("starts_with(x, '# ')")} AS a, {share("contains(x, ',') AND regexp_matches(x, '[\\p{Han}]')")} AS v
    FROM (SELECT {sig} AS sig)))"""


@register("doc_format", "WITH s AS (" + " UNION ALL ".join(
    [f"SELECT doc_id, '{k}' AS kind, {d.shaped_sql('text', k)} AS body FROM documents" for k in _KINDS]
    + ["SELECT doc_id, 'plain', text FROM documents", f"SELECT doc_id, 'mixed', {d.mixed_sql('text')} FROM documents"])
    + f") SELECT doc_id, kind, {_format_sql('body')} AS format, {_format_sql('body', True)} AS format_without_rules "
      "FROM s")
def doc_format(spark, sf_dir):
    base = docs(spark, sf_dir)
    kinds = {k: d.shaped(F.col("text"), k) for k in _KINDS} | {"plain": F.col("text"), "mixed": d.mixed(F.col("text"))}
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("body")) for k, c in kinds.items()])
    rows = base.select("doc_id", F.explode(parts).alias("p")).select(
        "doc_id", "p.kind", formats.significant_lines(F.col("p.body")).alias("_lines"))
    return rows.select("doc_id", "kind", formats.format_of(F.col("_lines")).alias("format"),
                       formats.format_of(F.col("_lines"), ignore_rules=True).alias("format_without_rules"))


def _blocks_sql(kind: str, separator: str) -> str:
    """blocks(doc_id, b, bpos): the non-empty trimmed blocks of the shaped documents."""
    return (f"raw AS (SELECT doc_id, list_filter(list_transform(string_split({d.shaped_sql('text', kind)}, "
            f"chr(10) || '{separator}' || chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS bs FROM documents), "
            "blocks AS (SELECT doc_id, unnest(bs) AS b, generate_subscripts(bs, 1) AS bpos FROM raw)")


@register("faq_pairs", f"""
WITH {_blocks_sql('faq', '---')},
ok AS (SELECT * FROM blocks WHERE regexp_matches(b, 'Q[：:]') AND regexp_matches(b, 'A[：:]'))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY bpos) AS entry,
  {_strip("regexp_extract(b, 'Q[：:](.*)', 1)")} AS question, {_strip("regexp_extract(b, 'A[：:](.*)', 1)")} AS answer
FROM ok""")
def faq_pairs(spark, sf_dir):
    return documents.parse_faq(docs(spark, sf_dir).withColumn("text", d.shaped(F.col("text"), "faq")))


_LINES = f"list_filter(list_transform(string_split(b, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')"


@register("dialogue_turns", f"""
WITH {_blocks_sql('dialogue', '---')},
t AS (SELECT doc_id, bpos, list_filter({_LINES},
    lambda x: regexp_matches(x, '^(User:|用户：|顾客：|客户：|Assistant:|客服：|助手：)')) AS ts FROM blocks),
n AS (SELECT doc_id, ts, row_number() OVER (PARTITION BY doc_id ORDER BY bpos) AS dialogue FROM t WHERE len(ts) >= 2),
e AS (SELECT doc_id, dialogue, unnest(ts) AS x, generate_subscripts(ts, 1) AS turn FROM n)
SELECT doc_id, dialogue, turn, CASE WHEN regexp_matches(x, '^(User:|用户：|顾客：|客户：)') THEN '顾客' ELSE '客服' END AS role,
  {_strip("regexp_replace(x, '^[^:：]*[:：]', '')")} AS text FROM e""")
def dialogue_turns(spark, sf_dir):
    return documents.parse_dialogue(docs(spark, sf_dir).withColumn("text", d.shaped(F.col("text"), "dialogue")))


def _field(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(b, '{pattern}') THEN {_strip(f'''regexp_extract(b, '{pattern}', 1)''')} END"


@register("articles", f"""
WITH {_blocks_sql('article', '===')},
p AS (SELECT doc_id, bpos, {_field('# (.+)')} AS title, {_field('## 类别[：:][[:space:]]*(.+)')} AS category,
  {_field('## 关键词[：:][[:space:]]*(.+)')} AS keywords, {_strip(f'''array_to_string(list_filter({_LINES},
    lambda x: NOT starts_with(x, '# ') AND NOT starts_with(x, '## ') AND NOT starts_with(x, '===')), ' ')''')} AS body
  FROM blocks)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY bpos) AS article, title, category, keywords, body
FROM p WHERE title IS NOT NULL AND NOT {_blank('body')}""")
def articles(spark, sf_dir):
    return documents.parse_articles(docs(spark, sf_dir).withColumn("text", d.shaped(F.col("text"), "article")))


_CSV_LINES = _LINES.replace("string_split(b,", f"string_split({d.shaped_sql('text', 'csv')},")


@register("csv_qa", f"""
WITH l AS (SELECT doc_id, list_slice({_CSV_LINES}, 2, 1000000000) AS ls FROM documents),
f AS (SELECT doc_id, pos, string_split_regex(regexp_replace(x, '[，,]+$', ''), '[，,]') AS f
  FROM (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS pos FROM l))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS record, {_strip('f[1]')} AS question,
  {_strip('f[2]')} AS answer, {_strip('f[3]')} AS category
FROM f WHERE len(f) >= 2 AND {_strip('f[1]')} <> '' AND {_strip('f[2]')} <> ''""")
def csv_qa(spark, sf_dir):
    return documents.parse_csv_qa(docs(spark, sf_dir).withColumn("text", d.shaped(F.col("text"), "csv")))


def _mixed_sql() -> str:
    nl = "chr(10)"
    bs = (f"list_filter(list_transform(string_split_regex({d.mixed_sql('text')}, '\\n\\n+|\\n---\\n|\\n===\\n'), "
          f"lambda x: {_strip('x')}), lambda x: x <> '' AND NOT starts_with(x, '==='))")
    turns = (f"list_filter({_LINES}, lambda x: regexp_matches(x, '^(User:|用户：|顾客：|客户：|Assistant:|客服：|助手：)'))")
    faq = (f"CASE WHEN regexp_matches(b, 'Q[：:]') AND regexp_matches(b, 'A[：:]') THEN 'FAQ-1:' || {nl} || '问题：' || "
           f"{_strip('''regexp_extract(b, 'Q[：:](.*)', 1)''')} || {nl} || '回答：' || "
           f"{_strip('''regexp_extract(b, 'A[：:](.*)', 1)''')} || {nl} || {nl} ELSE b END")
    conv = (f"CASE WHEN len({turns}) >= 2 THEN '对话-1:' || {nl} || array_to_string(list_transform({turns}, lambda x: "
            f"CASE WHEN regexp_matches(x, '^(User:|用户：|顾客：|客户：)') THEN '顾客：' ELSE '客服：' END || "
            f"{_strip('''regexp_replace(x, '^[^:：]*[:：]', '')''')} || {nl}), '') || {nl} ELSE b END")
    body = _strip(f"array_to_string(list_filter({_LINES}, lambda x: NOT starts_with(x, '# ') AND "
                  "NOT starts_with(x, '## ') AND NOT starts_with(x, '===')), ' ')")
    opt = lambda label, pattern: f"coalesce('{label}：' || {_field(pattern)} || {nl}, '')"
    art = (f"CASE WHEN regexp_matches(b, '# (.+)') AND {body} <> '' THEN '文章-1:' || {nl} || {opt('标题', '# (.+)')} || "
           f"{opt('类别', '## 类别[：:][[:space:]]*(.+)')} || {opt('关键词', '## 关键词[：:][[:space:]]*(.+)')} || "
           f"'内容：' || {body} || {nl} || {nl} ELSE b END")
    return f"""
WITH raw AS (SELECT doc_id, {bs} AS bs FROM documents),
blocks AS (SELECT doc_id, b, pos, {_format_sql('b')} AS format
  FROM (SELECT doc_id, unnest(bs) AS b, generate_subscripts(bs, 1) AS pos FROM raw)),
p AS (SELECT doc_id, pos, format, CASE format WHEN 'FAQ' THEN {faq} WHEN 'CONVERSATION' THEN {conv}
    WHEN 'ARTICLE' THEN {art} ELSE b END AS content FROM blocks)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS block, format, content FROM p
WHERE len(string_split(regexp_replace(content, '\\n+$', ''), chr(10))) > 2"""


@register("mixed_blocks", _mixed_sql())
def mixed_blocks(spark, sf_dir):
    return documents.parse_mixed(docs(spark, sf_dir).withColumn("text", d.mixed(F.col("text"))))


def _list_of(body: str, separator: str) -> str:
    return (f"list_filter(list_transform(string_split({body}, chr(10) || '{separator}' || chr(10)), "
            f"lambda b: {_strip('b')}), lambda b: b <> '')")


def _numbered(items: str, one: str, body: str) -> str:
    """Items joined by ``one`` of item ``e`` and number ``n``; the text itself without items."""
    return (f"CASE WHEN len({items}) > 0 THEN array_to_string(list_transform({items}, lambda e, n: {one}), '') "
            f"ELSE {body} END")


def _lines_of(text: str) -> str:
    return f"list_filter(list_transform(string_split({text}, chr(10)), lambda l: {_strip('l')}), lambda l: l <> '')"


def _found(text: str, pattern: str) -> str:
    extracted = _strip(f"regexp_extract({text}, '{pattern}', 1)")
    return f"CASE WHEN regexp_matches({text}, '{pattern}') THEN {extracted} END"


def _labelled(label: str, value: str) -> str:
    return f"coalesce('{label}' || {value} || chr(10), '')"


def rendered_sql(body: str, fmt: str) -> str:
    """The text that is chunked, for a text expression of a known format other than MIXED."""
    nl, users = "chr(10)", "^(User:|用户：|顾客：|客户：)"
    faq = f"list_filter({_list_of(body, '---')}, lambda b: regexp_matches(b, 'Q[：:]') AND regexp_matches(b, 'A[：:]'))"
    faq_one = (f"'FAQ-' || n || ':' || {nl} || {_labelled('问题：', _found('e', 'Q[：:](.*)'))} || "
               f"{_labelled('回答：', _found('e', 'A[：:](.*)'))} || {nl}")
    turns = (f"list_filter({_lines_of('b')}, "
             "lambda l: regexp_matches(l, '^(User:|用户：|顾客：|客户：|Assistant:|客服：|助手：)'))")
    talks = f"list_filter(list_transform({_list_of(body, '---')}, lambda b: {turns}), lambda t: len(t) >= 2)"
    said = _strip("regexp_replace(l, '^[^:：]*[:：]', '')")
    talk_one = (f"'对话-' || n || ':' || {nl} || array_to_string(list_transform(e, lambda l: CASE WHEN "
                f"regexp_matches(l, '{users}') THEN '顾客：' ELSE '客服：' END || {said} || {nl}), '') || {nl}")
    inner = lambda x: _strip(f"array_to_string(list_filter({_lines_of(x)}, lambda l: NOT starts_with(l, '# ') AND "  # noqa: E731
                             "NOT starts_with(l, '## ') AND NOT starts_with(l, '===')), ' ')")
    arts = f"list_filter({_list_of(body, '===')}, lambda b: regexp_matches(b, '# (.+)') AND NOT {_blank(inner('b'))})"
    art_one = (f"'文章-' || n || ':' || {nl} || {_labelled('标题：', _found('e', '# (.+)'))} || "
               f"{_labelled('类别：', _found('e', '## 类别[：:][[:space:]]*(.+)'))} || "
               f"{_labelled('关键词：', _found('e', '## 关键词[：:][[:space:]]*(.+)'))} || "
               f"'内容：' || {inner('e')} || {nl} || {nl}")
    rows = _lines_of(body)
    rows = (f"CASE WHEN starts_with({rows}[1], 'question') OR starts_with({rows}[1], '问题') "
            f"THEN list_slice({rows}, 2, 1000000000) ELSE {rows} END")
    pairs = (f"list_filter(list_transform({rows}, lambda l: string_split_regex(regexp_replace(l, '[，,]+$', ''), '[，,]')), "
             f"lambda p: len(p) >= 2 AND {_strip('p[1]')} <> '' AND {_strip('p[2]')} <> '')")
    pair_one = (f"'CSV-QA-' || n || ':' || {nl} || {_labelled('问题：', _strip('e[1]'))} || "
                f"{_labelled('回答：', _strip('e[2]'))} || {_labelled('类别：', _strip('e[3]'))} || {nl}")
    return (f"CASE {fmt} WHEN 'FAQ' THEN {_numbered(faq, faq_one, body)} "
            f"WHEN 'CONVERSATION' THEN {_numbered(talks, talk_one, body)} "
            f"WHEN 'ARTICLE' THEN {_numbered(arts, art_one, body)} WHEN 'CSV' THEN {_numbered(pairs, pair_one, body)} "
            f"ELSE {body} END")


def parsed_ctes(source: str) -> str:
    """CTE parsed(k, text) of a select with the columns k and body: the text that is chunked."""
    return f"""
src AS MATERIALIZED (SELECT *, {_format_sql('body')} AS format FROM ({source})),
mixed_bs AS (SELECT k, unnest(bs) AS b, generate_subscripts(bs, 1) AS pos FROM (SELECT k, list_filter(list_transform(
  string_split_regex(body, '\\n\\n+|\\n---\\n|\\n===\\n'), lambda b: {_strip('b')}),
  lambda b: b <> '' AND NOT starts_with(b, '===')) AS bs FROM src WHERE format = 'MIXED')),
mixed_ps AS (SELECT k, pos, {rendered_sql('b', 'f')} AS content FROM (SELECT *, {_format_sql('b')} AS f FROM mixed_bs)),
mixed_ts AS (SELECT k, string_agg(content || chr(10), '' ORDER BY pos) AS t FROM mixed_ps
  WHERE len(string_split(regexp_replace(content, '\\n+$', ''), chr(10))) > 2 GROUP BY k),
parsed AS (SELECT k, CASE WHEN {_blank('body')} THEN '' WHEN format = 'MIXED' THEN coalesce(t, body)
  ELSE {rendered_sql('body', 'format')} END AS text FROM src LEFT JOIN mixed_ts USING (k))"""


_SHAPED_DOCS = " UNION ALL ".join(
    f"SELECT doc_id || '/{k}' AS k, {d.shaped_sql('text', k)} AS body FROM documents" for k in _KINDS)


@register("structured_text", f"""
WITH {parsed_ctes(_SHAPED_DOCS)}
SELECT string_split(k, '/')[1]::BIGINT AS doc_id, string_split(k, '/')[2] AS kind, length(text) AS n_chars FROM parsed""")
def structured_text(spark, sf_dir):
    """Length of the text each shaped document is chunked from."""
    base = docs(spark, sf_dir)
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), d.shaped(F.col("text"), k).alias("body")) for k in _KINDS])
    return base.select("doc_id", F.explode(parts).alias("p")).select(
        "doc_id", "p.kind", F.length(formats.structured_text(F.col("p.body"))).alias("n_chars"))


@register("chunk_documents", f"""
WITH w AS (SELECT doc_id, list_filter(string_split({q.clean('text')}, ' '), lambda x: x <> '') AS ws FROM documents),
n AS (SELECT doc_id, ws, greatest(ceil((len(ws) - 20) / 180), 1)::BIGINT AS total FROM w WHERE len(ws) > 0),
c AS (SELECT doc_id, total, i, array_to_string(list_slice(ws, i * 180 + 1, i * 180 + 200), ' ') AS content
  FROM (SELECT doc_id, ws, total, unnest(range(total)) AS i FROM n))
SELECT doc_id, i AS chunk_index, total AS total_chunks, md5(content) AS content_md5, length(content) AS char_count FROM c""")
def chunk_documents(spark, sf_dir):
    return documents.chunk_text(docs(spark, sf_dir), 200, 20).select(
        "doc_id", "chunk_index", "total_chunks", F.md5(F.col("content").cast("binary")).alias("content_md5"),
        "char_count")


@register("fingerprints", """
SELECT doc_id, 'rag:search:' || md5(text) AS cache_key, sha256(text) AS query_hash,
  source || '#' || sha256(text)[1:16] AS dataset_key FROM documents""")
def fingerprints(spark, sf_dir):
    body = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.cache_key("rag:search:", body).alias("cache_key"), text.query_hash(body).alias("query_hash"),
        text.fingerprint(F.col("source"), body).alias("dataset_key"))


@register("token_estimates", """
SELECT doc_id, 256 + ceil(length(text) * 1.0)::BIGINT AS request_tokens, (length(text) // 2)::BIGINT AS output_tokens,
  CASE WHEN length(text) > 80 THEN text[1:80] || '...' ELSE text END AS preview FROM documents""")
def token_estimates(spark, sf_dir):
    body = F.col("text")
    return docs(spark, sf_dir).select(
        "doc_id", text.estimate_tokens(body).alias("request_tokens"), text.generation_tokens(body).alias("output_tokens"),
        text.truncate(body, 80).alias("preview"))
