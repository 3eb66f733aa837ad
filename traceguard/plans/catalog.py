"""Every operator as a query over the test tables, with SQL that says the same.

Arrays are joined with ``|`` in the results, so that both engines give plain columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceguard.functions import patterns, pii, risk, secrets, text, trajectory, urls, vectors
from traceguard.functions import variants as V
from traceguard.operators import events, traces
from traceguard.operators import scan as S
from traceguard.operators.decisions import response_gate, sync_check
from traceguard.sources import kafka, tables
from traceguard.streaming.jobs import CHECK_RESULT, DETAILS, GATE_RESULT

from . import derived as D
from . import oracle as O
from .post_call import post_call, texts, trajectories

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def joined(name: str, alias: str | None = None) -> F.Column:
    return F.array_join(name, "|").alias(alias or name)


NORMAL_SQL = f"{D.PROMPTS_SQL}, n AS MATERIALIZED (SELECT conv_id, turn, role, prompt, {O.normalized('prompt')} AS t FROM prompts)"


def _tier_sql(f: patterns.Family) -> str:
    return f"""WITH {NORMAL_SQL}, h AS MATERIALIZED (SELECT conv_id, turn, {O.strong('t', f)} AS s, {O.weak('t', f)} AS w FROM n)
SELECT conv_id, turn, {O.join('list_concat(s, w)')} AS patterns, len(s) + len(w) > 0 AS detected, {O.tier_score('s', 'w')} AS score, {O.level_name('(' + O.tier_level('s', 'w') + ')')} AS level FROM h"""


def _tier(spark: SparkSession, sf_dir: str, f: patterns.Family) -> DataFrame:
    x = D.prompts(spark, sf_dir).withColumn("t", text.normalize_text(F.col("prompt"))).withColumn("r", patterns.tiered(F.col("t"), f))
    return x.select("conv_id", "turn", joined("r.patterns", "patterns"), "r.detected", "r.score", risk.level_name(F.col("r.level")).alias("level"))


@query(_tier_sql(patterns.INJECTION))
def injection_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tier(spark, sf_dir, patterns.INJECTION)


@query(_tier_sql(patterns.JAILBREAK))
def jailbreak_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tier(spark, sf_dir, patterns.JAILBREAK)


@query(_tier_sql(patterns.SKELETON))
def skeleton_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tier(spark, sf_dir, patterns.SKELETON)


@query(f"""WITH {NORMAL_SQL}, h AS MATERIALIZED (SELECT conv_id, turn, {O.strong('t', patterns.JAILBREAK)} AS s FROM n)
SELECT conv_id, turn, {O.join('s')} AS patterns, len(s) > 0 AS detected, round(len(s) / 35.0::DOUBLE, 4) AS score FROM h""")
def flat_pattern_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = D.prompts(spark, sf_dir).withColumn("t", text.normalize_text(F.col("prompt"))).withColumn("r", patterns.flat(F.col("t"), patterns.JAILBREAK))
    return x.select("conv_id", "turn", joined("r.patterns", "patterns"), "r.detected", "r.score")


_INJ, _JB, _SK = patterns.FAMILIES
LEVELS_SQL = f"""lv AS MATERIALIZED (SELECT n.*, {O.strong('t', _INJ)} AS is_, {O.weak('t', _INJ)} AS iw, {O.strong('t', _JB)} AS js, {O.weak('t', _JB)} AS jw, {O.strong('t', _SK)} AS ks, {O.weak('t', _SK)} AS kw FROM n),
ranked AS MATERIALIZED (SELECT *, {O.tier_level('is_', 'iw')} AS il, {O.tier_level('js', 'jw')} AS jl, {O.tier_level('ks', 'kw')} AS kl FROM lv)"""


@query(f"""WITH {NORMAL_SQL}, {LEVELS_SQL}, c AS (
  SELECT conv_id, turn, greatest(il, jl, kl) AS rank, array_to_string(list_filter([CASE WHEN il > 0 THEN 'prompt_injection' END, CASE WHEN jl > 0 THEN 'jailbreak' END, CASE WHEN kl > 0 THEN 'skeleton_key' END], lambda x: x IS NOT NULL), ', ') AS types FROM ranked)
SELECT conv_id, turn, rank < 3 AS allow, CASE WHEN rank = 3 THEN 'Blocked by traceguard: ' || types END AS block_reason, {O.level_name('rank')} AS risk_level, types AS attack_types FROM c""")
def precall_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = S.check(D.prompts(spark, sf_dir))
    return x.select("conv_id", "turn", "allow", "block_reason", "risk_level", F.array_join("attack_types", ", ").alias("attack_types"))


@query("""WITH m AS (SELECT conv_id, turn, [NULL, 'sdk_security', 'security_check_sync', 'response_gate_check', 'other', 'broken'][conv_id % 6 + 1] AS op FROM conversations)
SELECT CASE WHEN op = 'broken' THEN 'malformed' WHEN op = 'other' THEN 'unknown' ELSE coalesce(op, 'sdk_security') END AS route, count(*) AS messages FROM m GROUP BY 1""")
def op_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.table(spark, sf_dir, "conversations")
    op = F.element_at(F.array(F.lit(None), *map(F.lit, ("sdk_security", "security_check_sync", "response_gate_check", "other", "broken"))), (F.col("conv_id") % 6 + 1).cast("int"))
    value = F.when(op == "broken", F.lit("{oops")).otherwise(F.to_json(F.struct(op.alias("operation"), F.col("text").alias("prompt"))))
    return kafka.route(kafka.decode(c.select(value.alias("value")))).groupBy("route").agg(F.count("*").alias("messages"))


def _conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, event): all turns of a conversation as messages; content as text, as parts, or as another list."""
    c = D.table(spark, sf_dir, "conversations")
    part = F.array(F.struct(F.lit("text").alias("type"), F.substring("text", 1, 20).alias("text")), F.struct(F.lit("input").alias("type"), F.substring("text", F.lit(21), F.length("text")).alias("text")))
    multi = F.to_json(F.struct("role", part.alias("content")))
    plain = F.to_json(F.struct("role", F.col("text").alias("content")))
    one = F.when(F.col("turn") % 3 == 1, multi).otherwise(plain)
    grouped = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", one.alias("m")))).alias("ms"))
    name = F.element_at(F.array(*map(F.lit, ("messages", "contents", "input"))), (F.col("conv_id") % 3 + 1).cast("int"))
    listed = F.concat(F.lit('{"messages": [], "'), name, F.lit('": ['), F.array_join(F.transform("ms", lambda m: m["m"]), ","), F.lit("]}"))
    listed = F.when(name == "messages", F.replace(listed, F.lit('"messages": [], '), F.lit(""))).otherwise(listed)
    return grouped.select("conv_id", F.try_parse_json(listed).alias("event"))


_PARTS_SQL = "CASE WHEN turn % 3 = 1 THEN array_to_string(list_filter([substr(text, 1, 20), substr(text, 21)], lambda x: length(x) > 0), ' ') ELSE text END"


@query(f"""WITH p AS (SELECT conv_id, turn, role, {_PARTS_SQL} AS t FROM conversations)
SELECT conv_id, coalesce(string_agg(t, chr(10) ORDER BY turn) FILTER (role NOT IN ('system', 'developer') AND t <> ''), '') AS prompt FROM p GROUP BY conv_id""")
def prompt_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversation_events(spark, sf_dir).select("conv_id", events.prompt_of(events.native_messages(F.col("event"))).alias("prompt"))


@query("""SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || role WHEN 2 THEN text ELSE '12' END AS response FROM conversations WHERE conv_id % 5 <> 4""")
def response_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.table(spark, sf_dir, "conversations")
    k = F.col("conv_id") % 4
    as_text = F.to_json(F.struct(F.col("text").alias("response")))
    as_list = F.to_json(F.struct(F.array(F.col("text"), F.lit(""), F.col("role")).alias("output")))
    as_object = F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("output")))
    json = F.when(F.col("conv_id") % 5 == 4, F.lit('{"response": "", "output": []}')).when(k == 0, as_text).when(k == 1, as_list).when(k == 2, as_object).otherwise(F.lit('{"output": 12}'))
    x = c.withColumn("event", F.try_parse_json(json)).withColumn("response", events.response_of(F.col("event")))
    return x.where("response <> ''").select("conv_id", "turn", "response")


@query("""WITH f AS (SELECT conv_id, turn, role, text FROM conversations WHERE text <> '')
SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 AND role IN ('system', 'developer') THEN 'hello' WHEN conv_id % 3 = 0 THEN 'hello' || chr(10) || text ELSE text END AS prompt,
  CASE WHEN conv_id % 2 = 0 THEN 'answer ' || turn ELSE 'last' END AS response, CASE WHEN turn % 2 = 0 THEN 'search' END AS tool,
  CASE WHEN turn % 2 = 0 THEN text END AS arguments, true AS foreign_event FROM f""")
def openinference_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.table(spark, sf_dir, "conversations").where("text <> ''")
    q = lambda x: F.to_json(F.struct(x.alias("v")))
    raw = lambda x: F.regexp_replace(F.regexp_replace(q(x), '^\\{"v":', ""), "\\}$", "")
    collected = F.concat(F.lit('"llm.input_messages.10.message.role":'), raw(F.col("role")), F.lit(',"llm.input_messages.10.message.content":'), raw(F.col("text")), F.lit(',"llm.input_messages.2.message.content":"hello","llm.input_messages.2.message.role":"user","llm.input_messages.x.message.role":"user"'))
    value = F.concat(F.lit('"input.value":'), raw(F.when(F.col("conv_id") % 3 == 1, F.col("text")).otherwise(F.concat(F.lit("["), F.to_json(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))), F.lit("]")))))
    answer = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(',"output.value":"answer '), F.col("turn").cast("string"), F.lit('"'))).otherwise(F.lit(',"llm.output_messages.1.message.content":"last","llm.output_messages.0.message.content":"first"'))
    tool = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(',"tool.name":"search","tool.parameters":'), raw(F.col("text")))).otherwise(F.lit(""))
    json = F.concat(F.lit('{"messages":[],"attributes":{'), F.when(F.col("conv_id") % 3 == 0, collected).otherwise(value), answer, tool, F.lit("}}"))
    x = c.withColumn("event", F.try_parse_json(json))
    prompt, response = events.prompt_and_response(F.col("event"))
    x = x.withColumn("call", events.span_tool_call(F.col("event")))
    return x.select("conv_id", "turn", prompt.alias("prompt"), response.alias("response"), F.col("call.name").alias("tool"), F.col("call.arguments").alias("arguments"), events.is_openinference(F.col("event")).alias("foreign_event"))


@query("SELECT doc_id, substr(text || text || text || text, 1, 100000) AS capped, length(substr(text || text || text || text, 1, 100000)) AS n FROM documents")
def cap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = text.cap(F.concat("text", "text", "text", "text"))
    return D.table(spark, sf_dir, "documents").select("doc_id", capped.alias("capped"), F.length(capped).cast("long").alias("n"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(regexp_replace(text, '[^\x00-\x7F]', '?', 'g'), 'e', 'e' || chr(7) || '  ' || chr(10)), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g')) AS plain
FROM documents""")
def normalize_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, what lies beyond ASCII written as question marks."""
    ascii_ = F.regexp_replace("text", "[^\\x00-\\x7F]", "?")
    return D.table(spark, sf_dir, "documents").select("doc_id", F.trim(text.normalize_text(F.replace(ascii_, F.lit("e"), F.lit("e\x07  \n")))).alias("plain"))


@query()
def normalize_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NFKC has no counterpart in SQL; tests hold it against Python's."""
    wide = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ")
    return D.table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.when(F.col("doc_id") % 3 == 0, wide).otherwise(F.col("text"))).alias("plain"))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, texts): the planted prompts of a conversation in order."""
    return D.prompts(spark, sf_dir).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "prompt"))), lambda x: x["prompt"]).alias("texts"))


def _indirect_sql(label: str) -> str:
    return f"""WITH {NORMAL_SQL}, {LEVELS_SQL}, o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, prompt) - 1 AS i, len(is_) + len(js) > 0 AS hit FROM lv)
SELECT conv_id, coalesce(string_agg('{label}[' || i || ']', '|' ORDER BY i) FILTER (hit), '') AS sources FROM o GROUP BY conv_id"""


@query(_indirect_sql("tool_output"))
def indirect_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = S.normalized_arrays(_grouped(spark, sf_dir), ("texts",))
    return x.select("conv_id", F.array_join(S.indirect_sources(F.col("texts_plain"), "tool_output"), "|").alias("sources"))


@query(_indirect_sql("context_doc"))
def indirect_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = S.normalized_arrays(_grouped(spark, sf_dir), ("texts",))
    return x.select("conv_id", F.array_join(S.indirect_sources(F.col("texts_plain"), "context_doc"), "|").alias("sources"))


@query(f"""WITH {NORMAL_SQL}, {LEVELS_SQL}, o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, prompt) - 1 AS i, len(is_) > 0 OR jl > 0 OR len(ks) > 0 AS hit FROM ranked)
SELECT conv_id, coalesce(string_agg('image[' || i || ']', '|' ORDER BY i) FILTER (hit), '') AS sources FROM o GROUP BY conv_id""")
def image_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir).select("conv_id", F.array_join(S.image_sources(events.labelled_texts(F.col("texts"))), "|").alias("sources"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 2 THEN '' ELSE url END AS urls, CASE page_id % 6 WHEN 2 THEN 'aGVsbG8=' ELSE '' END AS data, CASE page_id % 6 WHEN 0 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/gif' ELSE '' END AS mimes
FROM pages WHERE page_id % 6 < 4""")
def image_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.table(spark, sf_dir, "pages")
    k = F.col("page_id") % 6
    u = F.col("url")
    part = F.when(k == 0, F.to_json(F.struct(F.struct(F.lit("image").alias("kind"), F.lit("url").alias("source"), u.alias("url"), F.lit("image/png").alias("mime")).alias("_media_ref"))))
    part = part.when(k == 1, F.to_json(F.struct(F.struct(u.alias("url")).alias("image_url")))).when(k == 2, F.lit('{"inlineData": {"data": "aGVsbG8=", "mimeType": "image/jpeg"}}'))
    part = part.when(k == 3, F.to_json(F.struct(F.struct(u.alias("url"), F.lit("image/gif").alias("media_type")).alias("source")))).when(k == 4, F.to_json(F.struct(F.struct(F.lit("image").alias("kind"), F.lit("base64").alias("source"), F.lit("x").alias("sha256")).alias("_media_ref"), u.alias("image_url"))))
    json = F.concat(F.lit('{"messages": [{"role": "user", "content": ["look", {"type": "text", "text": "x"}, '), part.otherwise(F.lit('"none"')), F.lit("]}]}"))
    x = p.withColumn("images", events.images(F.try_parse_json(json))).where("size(images) > 0")
    named = lambda f: F.array_join(F.transform("images", lambda i: F.coalesce(i[f], F.lit(""))), "|")
    return x.select("page_id", named("url").alias("urls"), named("data").alias("data"), named("mime").alias("mimes"))


_HOSTS = ("http://127.0.0.1/x", "https://10.0.0.8:8443/", "http://[::1]/", "http://[::ffff:192.168.0.1]/a", "http://169.254.169.254/latest", "https://8.8.8.8/i.png", "ftp://8.8.8.8/", "http://user@172.20.1.1/", "http://localhost/", "http://[2606:4700::1111]/")


@query("""SELECT page_id, CASE page_id % 11 WHEN 5 THEN true WHEN 9 THEN true WHEN 10 THEN regexp_matches(url, '^https?://[^/]') ELSE false END AS public FROM pages""")
def url_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 11
    url = F.when(k == 10, F.col("url")).otherwise(F.get(F.array(*map(F.lit, _HOSTS)), k.cast("int")))
    return D.table(spark, sf_dir, "pages").select("page_id", urls.is_public_url(url).alias("public"))


PII_SQL = f"{D.PAPERS_SQL}, e AS MATERIALIZED (SELECT doc_id, text, {O.entities('text')} AS types FROM papers), x AS MATERIALIZED (SELECT *, {O.entity_score('types')} AS score FROM e)"


def _pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.papers(spark, sf_dir).withColumn("spans", pii.pii_spans(F.col("text")))


@query(f"WITH {PII_SQL} SELECT doc_id, {O.join('types')} AS types FROM x")
def pii_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pii(spark, sf_dir).select("doc_id", F.array_join(pii.entities(F.col("spans")), "|").alias("types"))


@query(f"WITH {PII_SQL} SELECT doc_id, list_filter(types, lambda t: ends_with(t, '_KEY') OR t = 'GITHUB_TOKEN')[1] AS key FROM x WHERE len(list_filter(types, lambda t: ends_with(t, '_KEY') OR t = 'GITHUB_TOKEN')) > 0")
def pii_custom_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = D.papers(spark, sf_dir).withColumn("types", pii.entities(pii.pii_spans(F.col("text"), recognizers=pii.KEYS)))
    return D.kept(x, "size(types) > 0").select("doc_id", F.get("types", 0).alias("key"))


@query(f"WITH {PII_SQL} SELECT doc_id, score, {O.level_name('(' + O.score_level('score') + ')')} AS level FROM x")
def pii_score_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _pii(spark, sf_dir).withColumn("score", pii.entity_score(pii.entities(F.col("spans"))))
    return x.select("doc_id", "score", risk.level_name(risk.level_of_score(F.col("score"))).alias("level"))


@query(f"WITH {PII_SQL}, k AS (SELECT doc_id, list_filter(types, lambda t: NOT (t = 'EMAIL_ADDRESS' OR (doc_id % 2 = 0 AND t = 'PHONE_NUMBER'))) AS types FROM x) SELECT doc_id, {O.join('types')} AS types, {O.entity_score('types')} AS score FROM k")
def pii_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    ignore = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("EMAIL_ADDRESS"), F.lit("PHONE_NUMBER"))).otherwise(F.array(F.lit("EMAIL_ADDRESS")))
    x = D.papers(spark, sf_dir).withColumn("types", pii.entities(pii.pii_spans(F.col("text"), ignore)))
    return x.select("doc_id", joined("types"), pii.entity_score(F.col("types")).alias("score"))


_REDACTED = ("EMAIL_ADDRESS", "IP_ADDRESS")


@query(f"""WITH {D.PAPERS_SQL} SELECT doc_id, regexp_replace(regexp_replace(text, {D.quote(O.ENTITY_RX['EMAIL_ADDRESS'])}, '<EMAIL_ADDRESS>', 'g'), {D.quote(O.ENTITY_RX['IP_ADDRESS'])}, '<IP_ADDRESS>', 'g') AS redacted FROM papers""")
def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = tuple(r for r in pii.RECOGNIZERS if r.entity in _REDACTED)
    x = D.papers(spark, sf_dir).withColumn("spans", pii.pii_spans(F.col("text"), recognizers=chosen))
    return x.select("doc_id", pii.redact(F.col("text"), F.col("spans")).alias("redacted"))


@query(f"""WITH {D.PAPERS_SQL}, d AS (SELECT doc_id, regexp_extract_all(text, '\\b[0-9]{{10}}\\b') AS bare, list_transform(regexp_extract_all(text, '\\b\\d{{4}}(?:\\.\\d{{2,4}}){{1,4}}\\b'), lambda v: regexp_replace(v, '[^0-9]', '', 'g')) AS codes,
  regexp_extract_all(text, '(?i)schedule[_\\s]?b[''\"]?\\s*[:=]\\s*[''\"]?(\\d{{10}})\\b', 1) AS listed FROM papers)
SELECT doc_id, len(bare) AS found, len(list_filter(bare, lambda v: NOT list_contains(codes, v) AND NOT list_contains(listed, v))) AS kept FROM d WHERE len(bare) > 0""")
def pii_hts_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = tuple(r for r in pii.RECOGNIZERS if r.entity == "PHONE_NUMBER" and "{10}" in r.regex)
    x = D.kept(D.papers(spark, sf_dir).withColumn("spans", pii.raw_spans(F.col("text"), recognizers=bare)), "size(spans) > 0")
    return x.select("doc_id", F.size("spans").cast("long").alias("found"), F.size(pii.drop_tariff_phones(F.col("spans"), F.col("text"))).cast("long").alias("kept"))


@query(f"""WITH {D.PAPERS_SQL}, d AS (SELECT doc_id, len(regexp_extract_all(text, '\\b([0-9]{{5}}-[0-9]{{4}}|[0-9]{{9}})\\b')) AS weak, len(regexp_extract_all(text, '\\b[0-9]{{5}}-[0-9]{{4}}\\b')) AS zips, len(regexp_extract_all(text, '\\b[0-9]{{3}}[-. ][0-9]{{2}}[-. ][0-9]{{4}}\\b')) AS proper FROM papers)
SELECT doc_id, weak + proper AS found, weak + proper - zips AS kept FROM d WHERE weak + proper > 0""")
def pii_zip_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = tuple(r for r in pii.RECOGNIZERS if r.entity == "US_SSN")
    x = D.kept(D.papers(spark, sf_dir).withColumn("spans", pii.raw_spans(F.col("text"), recognizers=numbers)), "size(spans) > 0")
    return x.select("doc_id", F.size("spans").cast("long").alias("found"), F.size(pii.drop_zip_numbers(F.col("spans"), F.col("text"))).cast("long").alias("kept"))


SECRETS_SQL = f"{D.PAPERS_SQL}, k AS MATERIALIZED (SELECT doc_id, text, {O.named_secrets('text')} AS types, {O.random_tokens('text')} AS tokens FROM papers)"


@query(f"WITH {SECRETS_SQL} SELECT doc_id, {O.join('types')} AS types FROM k WHERE len(types) > 0")
def secrets_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = D.papers(spark, sf_dir).withColumn("types", secrets.named_secrets(F.col("text")))
    return D.kept(x, "size(types) > 0").select("doc_id", joined("types"))


@query(f"WITH {SECRETS_SQL} SELECT doc_id, {O.join('tokens')} AS tokens FROM k WHERE len(tokens) > 0")
def secrets_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = D.papers(spark, sf_dir).withColumn("tokens", secrets.entropy_tokens(F.col("text")))
    return D.kept(x, "size(tokens) > 0").select("doc_id", joined("tokens"))


@query(f"WITH {SECRETS_SQL} SELECT doc_id, CASE WHEN len(types) > 0 THEN 1.0 WHEN len(tokens) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score, CASE WHEN len(types) > 0 THEN 'high' WHEN len(tokens) > 0 THEN 'medium' ELSE 'clean' END AS level FROM k")
def secret_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = D.papers(spark, sf_dir).withColumn("s", secrets.secrets(F.col("text")))
    return x.select("doc_id", secrets.secret_score(F.col("s.types"), F.col("s.detected")).alias("score"), risk.level_name(F.col("s.level")).alias("level"))


@query(f"WITH {SECRETS_SQL} SELECT doc_id, {O.join('types')} AS types FROM k WHERE len(types) > 0")
def secrets_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with an invisible character inside: only the normalised copy shows them."""
    split = F.regexp_replace("text", "(sk-proj-abc|AKIAAB|ghp_abc)", "$1​")
    x = D.papers(spark, sf_dir).withColumn("text", split).select("doc_id", secrets.hidden_secrets(F.col("text"))["types"].alias("types"))
    return D.kept(x, "size(types) > 0").select("doc_id", joined("types"))


@query(f"""WITH {D.PROMPTS_SQL}, o AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, prompt) - 1 AS i, list_filter({O.entities('prompt')}, lambda t: t <> 'EMAIL_ADDRESS') AS e, {O.named_secrets('prompt')} AS s, {O.random_tokens('prompt')} AS r FROM prompts),
h AS (SELECT conv_id, i, list_distinct(list_concat(e, s)) AS types FROM o WHERE len(e) + len(s) + len(r) > 0)
SELECT conv_id, string_agg('tool_input[' || i || ']', '|' ORDER BY i) AS sources, {O.join('list_sort(list_distinct(flatten(list(types))))')} AS types FROM h GROUP BY conv_id""")
def tool_exfil(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = S.normalized_arrays(_grouped(spark, sf_dir), ("texts",))
    x = x.withColumn("hits", S.exfiltration(F.col("texts"), F.col("texts_plain"), F.array(F.lit("EMAIL_ADDRESS"))))
    x = x.withColumns({"types": S.exfiltrated_types(F.col("hits")), "sources": S.labels(F.col("hits"))}).where("size(sources) > 0")
    return x.select("conv_id", joined("sources"), joined("types"))


@query("""WITH n AS (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE ' ' || event_type END AS name FROM events),
k AS (SELECT *, lower(trim(name)) AS key, row_number() OVER (PARTITION BY user_id, lower(trim(name)) ORDER BY event_id) AS nth FROM n)
SELECT user_id, string_agg(name, '|' ORDER BY event_id) AS violations FROM k WHERE nth = 1 AND key NOT IN ('click', 'view') AND user_id % 3 > 0 GROUP BY user_id""")
def tool_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.lit(" "), "event_type"))
    x = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", name.alias("name")))), lambda s: s["name"]).alias("names"))
    allowed = F.when(F.col("user_id") % 3 > 0, F.array(F.lit(" Click"), F.lit("VIEW"))).otherwise(F.expr("cast(array() as array<string>)"))
    return x.withColumn("bad", S.policy_violations(F.col("names"), allowed)).where("size(bad) > 0").select("user_id", joined("bad", "violations"))


_SIBLINGS_SQL = f"""{D.TRACES_SQL}, s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY organization_id, root_trace_id ORDER BY trace_id) AS n FROM traces WHERE type IN ('tool', 'function', 'vectorstore')),
pairs AS (SELECT t.organization_id, t.root_trace_id, t.trace_id, s.trace_id AS sibling, s.type AS stype, s.output, s.doc, s.input, s.name, row_number() OVER (PARTITION BY t.organization_id, t.root_trace_id, t.trace_id ORDER BY s.trace_id) AS k
  FROM traces t JOIN s ON s.organization_id = t.organization_id AND s.root_trace_id = t.root_trace_id AND s.trace_id <> t.trace_id AND s.n <= 51 WHERE t.type = 'llm')"""


@query(f"""WITH {_SIBLINGS_SQL}
SELECT t.organization_id, t.root_trace_id, t.trace_id, coalesce(string_agg(CASE WHEN stype <> 'vectorstore' AND trim(p.output) <> '' THEN p.output END, '|' ORDER BY sibling), '') AS tool_outputs, coalesce(string_agg(p.doc, '|' ORDER BY sibling), '') AS context_docs,
  coalesce(string_agg(p.input, '|' ORDER BY sibling), '') AS tool_inputs, coalesce(string_agg(CASE WHEN stype <> 'vectorstore' THEN p.name END, '|' ORDER BY sibling), '') AS tool_names
FROM traces t LEFT JOIN pairs p ON p.trace_id = t.trace_id AND p.k <= 50 WHERE t.type = 'llm' GROUP BY ALL""")
def sibling_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.traces(spark, sf_dir)
    x = traces.sibling_sources(t.where("type = 'llm'"), t)
    return x.select(*traces.KEY, "trace_id", *(joined(c) for c in traces.TEXTS))


@query(f"WITH {D.TRACES_SQL} SELECT t.trace_id, coalesce(p.type, '') AS parent_kind, coalesce(p.type, '') = 'llm' AS cross_agent FROM traces t LEFT JOIN traces p ON p.trace_id = t.parent_id AND p.organization_id = t.organization_id AND p.root_trace_id = t.root_trace_id")
def parent_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.traces(spark, sf_dir)
    return traces.parent_kinds(t, t).select("trace_id", "parent_kind", "cross_agent")


@query(f"""WITH {NORMAL_SQL}, {LEVELS_SQL}, par AS (SELECT a.*, coalesce(b.role <> 'system', false) AS cross_agent FROM ranked a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1)
SELECT conv_id, turn, cross_agent AND (il > 0 OR jl > 0) AS injected FROM par""")
def cross_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.traces(spark, sf_dir)
    ids = D.prompts(spark, sf_dir).withColumns({"organization_id": (F.col("conv_id") % 5).cast("string"), "root_trace_id": F.col("conv_id").cast("string"), "trace_id": F.lpad((F.col("conv_id") * 100 + F.col("turn")).cast("string"), 12, "0"), "parent_id": F.when(F.col("turn") > 0, F.lpad((F.col("conv_id") * 100 + F.col("turn") - 1).cast("string"), 12, "0"))})
    x = S.attack_tiers(traces.parent_kinds(ids, t), F.col("prompt"))
    return x.select("conv_id", "turn", (F.col("cross_agent") & (F.col("injection.detected") | F.col("jailbreak.detected"))).alias("injected"))


_CHAIN_SQL = f"""{D.TRACES_SQL}, {D.SCANS_SQL}, walk(trace_id, organization_id, root_trace_id, node, depth, chain) AS (
  SELECT t.trace_id, t.organization_id, t.root_trace_id, t.parent_id, 0, []::DOUBLE[] FROM traces t WHERE t.type = 'llm'
  UNION ALL
  SELECT w.trace_id, w.organization_id, w.root_trace_id, (SELECT n.parent_id FROM traces n WHERE n.type = 'llm' AND n.trace_id = w.node), depth + 1,
    CASE WHEN (SELECT security_risk_score FROM scans c WHERE c.trace_id = w.node) IS NULL THEN chain ELSE list_concat([(SELECT security_risk_score FROM scans c WHERE c.trace_id = w.node)], chain) END
  FROM walk w WHERE w.node IS NOT NULL AND depth < 12
), ended AS (SELECT trace_id, organization_id, root_trace_id, chain, row_number() OVER (PARTITION BY trace_id ORDER BY depth DESC) AS n FROM walk)"""


@query(f"WITH RECURSIVE {_CHAIN_SQL} SELECT trace_id, array_to_string(list_transform(chain, lambda s: (s * 100)::INT), '|') AS chain FROM ended WHERE n = 1")
def agent_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.traces(spark, sf_dir)
    x = traces.chain_scores(t.where("type = 'llm'"), t, D.scans(spark, sf_dir))
    return x.select("trace_id", F.array_join(F.transform("chain", lambda s: F.round(s * 100).cast("int").cast("string")), "|").alias("chain"))


_HISTORY_SQL = f"""{D.TRACES_SQL}, {D.SCANS_SQL}, p AS (SELECT t.trace_id, s.security_risk_score AS v, s.ingested_at AS t_at, row_number() OVER (PARTITION BY t.trace_id ORDER BY s.ingested_at DESC, s.trace_id DESC) AS n
  FROM traces t JOIN scans s ON s.organization_id = t.organization_id AND s.root_trace_id = t.root_trace_id AND s.trace_id <> t.trace_id WHERE t.type = 'llm')"""


@query(f"WITH {_HISTORY_SQL} SELECT t.trace_id, coalesce(string_agg((v * 100)::INT::VARCHAR, '|' ORDER BY t_at), '') AS history FROM traces t LEFT JOIN p ON p.trace_id = t.trace_id AND p.n <= 19 WHERE t.type = 'llm' GROUP BY t.trace_id")
def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.traces(spark, sf_dir).where("type = 'llm'")
    x = traces.session_history(t, D.scans(spark, sf_dir))
    return x.select("trace_id", F.array_join(F.transform("history", lambda s: F.round(s * 100).cast("int").cast("string")), "|").alias("history"))


_WINDOW_SQL = f"{D.SCANS_SQL}, w AS (SELECT trace_id, list(security_risk_score) OVER (PARTITION BY organization_id, root_trace_id ORDER BY ingested_at, trace_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS turns FROM scans)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.scans(spark, sf_dir).withColumn("turns", traces.backfilled_history())


@query(f"WITH {_WINDOW_SQL}, s AS (SELECT *, {O.slope('turns')} AS slope FROM w) SELECT trace_id, len(turns) AS session_turns, round(slope, 4) AS crescendo_score, slope >= 0.3 AND len(turns) >= 3 AND turns[-1] >= 0.25 AS crescendo_detected FROM s")
def crescendo(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _turns(spark, sf_dir)
    return x.select("trace_id", F.size("turns").cast("long").alias("session_turns"), F.round(trajectory.slope(F.col("turns")), 4).alias("crescendo_score"), trajectory.rising(F.col("turns")).alias("crescendo_detected"))


@query(f"WITH {_WINDOW_SQL} SELECT trace_id, array_to_string(list_transform(turns, lambda s: (round(s, 4) * 100)::INT), '|') AS trajectory FROM w")
def risk_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("trace_id", F.array_join(F.transform("turns", lambda s: F.round(F.round(s, 4) * 100).cast("int").cast("string")), "|").alias("trajectory"))


@query(f"""WITH RECURSIVE {_CHAIN_SQL}, l AS (SELECT e.trace_id, list_append(e.chain, s.security_risk_score) AS line, coalesce(p.type = 'llm', false) AS cross_agent FROM ended e JOIN scans s USING (trace_id) JOIN traces t ON t.trace_id = e.trace_id LEFT JOIN traces p ON p.trace_id = t.parent_id WHERE e.n = 1),
s AS (SELECT *, {O.slope('line')} AS slope FROM l)
SELECT trace_id, len(line) AS depth, round(slope, 4) AS escalation_score, cross_agent AND slope >= 0.3 AND len(line) >= 3 AND line[-1] >= 0.25 AS escalation FROM s""")
def trust_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = D.traces(spark, sf_dir), D.scans(spark, sf_dir)
    llm = t.where("type = 'llm'")
    on = [*traces.KEY, "trace_id"]
    x = traces.chain_scores(llm, t, s).join(s, on).join(traces.parent_kinds(llm, t).select(*on, "cross_agent"), on)
    x = trajectories(x.withColumn("history", F.expr("cast(array() as array<double>)")))
    return x.select("trace_id", F.col("agent_chain_depth").cast("long").alias("depth"), "escalation_score", F.col("trust_boundary_escalation").alias("escalation"))


_UNIT_SQL = "u AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings)"
_CENTROID_SQL = f"{_UNIT_SQL}, m AS (SELECT label, dim, avg(e[dim]) AS x FROM (SELECT label, e, unnest(range(1, 65)) AS dim FROM u) GROUP BY ALL), r AS (SELECT label, list(x ORDER BY dim) AS raw FROM m GROUP BY label), c AS MATERIALIZED (SELECT label, list_transform(raw, lambda x: x / sqrt(list_inner_product(raw, raw))) AS centroid FROM r)"


@query(f"WITH {_CENTROID_SQL} SELECT label, unnest(range(0, 64)) AS dim, round(unnest(centroid), 6) AS x FROM c")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vectors.centroids(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, scores): cosine with every label's centroid; there are as many centroids as labels, a handful."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    c = vectors.centroids(e, "label", "embedding")
    every = c.agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("all"))
    x = e.withColumn("all", every.scalar())
    return x.select("vec_id", "label", F.transform("all", lambda s: F.struct(vectors.cosine(F.col("embedding"), s["centroid"]).alias("score"), s["label"].alias("label"))).alias("scores"))


@query(f"""WITH {_CENTROID_SQL}, s AS (SELECT vec_id, c.label, list_inner_product(e, centroid) AS score FROM u CROSS JOIN c), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label DESC) AS n FROM s)
SELECT vec_id, label AS nearest, round(score, 6) AS score FROM k WHERE n = 1""")
def cosine_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _scored(spark, sf_dir).withColumn("best", F.array_max("scores"))
    return x.select("vec_id", F.col("best.label").alias("nearest"), F.round("best.score", 6).alias("score"))


def _two_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.get(F.transform(F.filter("scores", lambda s: s["label"] == i), lambda s: s["score"]), 0)
    return _scored(spark, sf_dir).select("vec_id", F.round(at(0), 6).alias("i"), F.round(at(1), 6).alias("j"))


_TWO_SQL = f"{_CENTROID_SQL}, s AS (SELECT vec_id, round(list_inner_product(e, (SELECT centroid FROM c WHERE label = 0)), 6) AS i, round(list_inner_product(e, (SELECT centroid FROM c WHERE label = 1)), 6) AS j FROM u)"


@query(f"""WITH {_TWO_SQL} SELECT vec_id, CASE WHEN i >= 0.41 AND i >= j THEN 'injection' WHEN j >= 0.46 THEN 'jailbreak' ELSE '' END AS scope, (i >= 0.41 AND i >= j) OR j >= 0.46 AS detected, CASE WHEN i >= 0.41 AND i >= j THEN i WHEN j >= 0.46 THEN j ELSE greatest(i, j) END AS score FROM s""")
def semantic_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _two_scores(spark, sf_dir).withColumn("v", vectors.verdict(F.col("i"), F.col("j")))
    return x.select("vec_id", "v.scope", "v.detected", "v.score")


@query(f"""WITH {_TWO_SQL}, g AS (SELECT vec_id // 5 AS grp, row_number() OVER (PARTITION BY vec_id // 5 ORDER BY vec_id) - 1 AS k, i FROM s)
SELECT grp, coalesce(string_agg('context_doc[' || k || ']', '|' ORDER BY k) FILTER (i >= 0.55), '') AS sources, greatest(max(i), 0.0) AS score FROM g GROUP BY grp""")
def rag_poisoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _two_scores(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 5).alias("grp")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "i"))), lambda s: s["i"]).alias("scores"))
    sources, most = S.poisoned_docs(F.col("scores"))
    return g.select("grp", F.array_join(sources, "|").alias("sources"), most.alias("score"))


@query("""WITH w AS (SELECT doc_id, text, CASE WHEN length(text) <= 1200 THEN [0] ELSE range(0, length(text), 900)[1:8] END AS starts FROM documents)
SELECT doc_id, k - 1 AS k, CASE WHEN length(text) <= 1200 THEN text ELSE substr(text, starts[k] + 1, 1200) END AS piece FROM (SELECT *, unnest(range(1, len(starts) + 1)) AS k FROM w)""")
def classifier_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(vectors.windows(F.col("text"))).alias("k", "piece")).select("doc_id", F.col("k").cast("long").alias("k"), "piece")


@query("SELECT event_id, (event_id % 101) / 100.0::DOUBLE >= 0.9 AND event_id % 2 = 0 AS detected, (event_id % 101) / 100.0::DOUBLE AS score FROM events")
def classifier_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("event_id") % 101 / F.lit(100.0)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    v = F.when(F.col("event_id") % 2 == 0, vectors.classifier_verdict(score, True)).otherwise(vectors.classifier_verdict(score, False))
    return e.select("event_id", v.alias("v")).select("event_id", "v.detected", "v.score")


#: A full scan of each prompt, its answer the document of the same number; what the tree adds stays out.
_ROLL_SQL = f"""{LEVELS_SQL}, f AS MATERIALIZED (SELECT *, {O.entities('prompt')} AS types, {O.named_secrets('prompt')} AS named, {O.random_tokens('prompt')} AS tokens FROM ranked),
full_ AS MATERIALIZED (SELECT *, {O.entity_score('types')} AS pscore, CASE WHEN len(named) > 0 THEN 1.0 WHEN len(tokens) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS sscore, CASE WHEN len(named) > 0 THEN 3 WHEN len(tokens) > 0 THEN 2 ELSE 0 END AS slevel FROM f),
roll AS MATERIALIZED (SELECT *, greatest(il, jl, kl, {O.score_level('pscore')}, slevel) AS rank, greatest(pscore, sscore, {O.tier_score('is_', 'iw')}, {O.tier_score('js', 'jw')}, {O.tier_score('ks', 'kw')}) AS total FROM full_)"""
_SCAN_SQL = f"{NORMAL_SQL}, {_ROLL_SQL}"


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scan(D.prompts(spark, sf_dir))


@query(f"""WITH {_SCAN_SQL} SELECT conv_id, turn, {O.join('types')} AS pii_entities_prompt, il > 0 AS injection_detected, {O.join('list_concat(is_, iw)')} AS injection_patterns, jl > 0 AS jailbreak_detected, {O.join('list_concat(js, jw)')} AS jailbreak_patterns, kl > 0 AS skeleton_key_detected,
  len(named) + len(tokens) > 0 AS secrets_detected, {O.join('named')} AS secret_types, {O.level_name('rank')} AS security_risk_level, total AS security_risk_score, rank = 3 AS should_block FROM roll""")
def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _scan(spark, sf_dir)
    return x.select("conv_id", "turn", joined("pii_entities_prompt"), "injection_detected", joined("injection_patterns"), "jailbreak_detected", joined("jailbreak_patterns"), "skeleton_key_detected", "secrets_detected", joined("secret_types"), "security_risk_level", "security_risk_score", "should_block")


@query(f"WITH {_SCAN_SQL} SELECT conv_id, {O.level_name('max(rank)')} AS worst, max(total) AS score, count(*) FILTER (rank = 3) AS blocked, count(*) AS turns FROM roll GROUP BY conv_id")
def risk_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, risk.LEVELS)), F.col("security_risk_level")).cast("int") - 1
    x = _scan(spark, sf_dir).groupBy("conv_id").agg(F.max(rank).alias("rank"), F.max("security_risk_score").alias("score"), F.count_if("should_block").alias("blocked"), F.count("*").alias("turns"))
    return x.select("conv_id", risk.level_name(F.col("rank")).alias("worst"), "score", "blocked", "turns")


#: What the tree, models and images add, by arithmetic on ids: each turn's prompt stands in one other place too.
_TREE_SQL = f"""{NORMAL_SQL}, {LEVELS_SQL}, f AS MATERIALIZED (SELECT *, {O.entities('prompt')} AS types, {O.named_secrets('prompt')} AS named, {O.random_tokens('prompt')} AS tokens,
  turn % 4 AS place, turn % 3 = 0 AS answered, conv_id % 2 = 0 AS cross_parent, (conv_id * 7 + turn * 11) % 60 / 100.0::DOUBLE AS i, (conv_id * 3 + turn * 5) % 60 / 100.0::DOUBLE AS j, (conv_id * 5 + turn * 17) % 80 / 100.0::DOUBLE AS near FROM ranked),
t AS MATERIALIZED (SELECT *, {O.entity_score('types')} AS pscore, CASE WHEN len(named) > 0 THEN 1.0 WHEN len(tokens) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS sscore, CASE WHEN len(named) > 0 THEN 3 WHEN len(tokens) > 0 THEN 2 ELSE 0 END AS slevel,
  (i >= 0.41 AND i >= j) OR j >= 0.46 AS sem, CASE WHEN i >= 0.41 AND i >= j THEN i WHEN j >= 0.46 THEN j ELSE greatest(i, j) END AS sem_score FROM f),
u AS MATERIALIZED (SELECT *, (place = 0 AND (len(is_) + len(js) > 0 OR near >= 0.55)) OR (place = 1 AND len(is_) + len(js) > 0) AS indirect, place = 1 AND near >= 0.55 AS rag, place = 2 AND len(types) + len(named) + len(tokens) > 0 AS exfil,
  conv_id % 4 = 0 AND role <> 'user' AS policy, place = 3 AND (len(is_) > 0 OR jl > 0 OR len(ks) > 0) AS image, cross_parent AND (il > 0 OR jl > 0 OR sem) AS crossed FROM t),
tree AS MATERIALIZED (SELECT *, greatest(il, jl, kl, CASE WHEN indirect OR rag OR policy OR image OR crossed OR sem THEN 3 WHEN exfil THEN 2 ELSE 0 END, {O.score_level('pscore')}, slevel) AS rank,
  greatest(pscore, sscore, {O.tier_score('is_', 'iw')}, {O.tier_score('js', 'jw')}, {O.tier_score('ks', 'kw')}, sem_score, CASE WHEN indirect OR policy OR image OR crossed THEN 1.0 ELSE 0.0 END, CASE WHEN rag THEN near ELSE 0.0 END, CASE WHEN exfil THEN 0.5 ELSE 0.0 END) AS total FROM u)"""


@query(f"""WITH {_TREE_SQL} SELECT conv_id, turn, indirect AS indirect_injection_detected, CASE WHEN indirect THEN CASE place WHEN 0 THEN 'tool_output[0]' ELSE 'context_doc[0]' END ELSE '' END AS indirect_injection_sources,
  rag AS rag_poisoning_detected, CASE WHEN place = 1 THEN near ELSE 0.0 END AS rag_poisoning_score, exfil AS tool_exfiltration_detected, CASE WHEN exfil THEN {O.join('list_sort(list_distinct(list_concat(types, named)))')} ELSE '' END AS tool_exfiltration_types,
  policy AS tool_policy_violation_detected, CASE WHEN policy THEN role ELSE '' END AS tool_policy_violations, crossed AS cross_agent_injection_detected, image AS image_injection_detected, CASE WHEN image THEN 'image[0]' ELSE '' END AS image_injection_sources,
  sem_score AS semantic_attack_score, CASE WHEN answered THEN {O.join('types')} ELSE '' END AS pii_entities_response, {O.level_name('rank')} AS security_risk_level, round(total, 4) AS security_risk_score, rank = 3 AS should_block FROM tree""")
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full scan with everything that a tree, models and images add, so that every term of the roll-up occurs."""
    text_, none = F.col("prompt"), F.expr("cast(array() as array<string>)")
    at = lambda k: F.when(F.col("turn") % 4 == k, F.array(text_)).otherwise(none)
    share = lambda a, b, m: (F.col("conv_id") * a + F.col("turn") * b) % m / F.lit(100.0)
    near = F.array(share(5, 17, 80))
    x = D.prompts(spark, sf_dir).withColumns({
        "tool_outputs": at(0),
        "context_docs": at(1),
        "tool_inputs": at(2),
        "image_texts": F.when(F.col("turn") % 4 == 3, F.array(F.struct(F.lit("image[0]").alias("label"), text_.alias("text")))),
        "tool_names": F.array("role"),
        "allowed_tools": F.when(F.col("conv_id") % 4 == 0, F.array(F.lit(" User "))),
        "cross_agent": F.col("conv_id") % 2 == 0,
        "injection_score": share(7, 11, 60),
        "jailbreak_score": share(3, 5, 60),
        "tool_scores": F.when(F.col("turn") % 4 == 0, near),
        "doc_scores": F.when(F.col("turn") % 4 == 1, near),
        "response": F.when(F.col("turn") % 3 == 0, text_),
    })
    x = S.scan(x)
    lists = ("indirect_injection_sources", "tool_exfiltration_types", "tool_policy_violations", "image_injection_sources", "pii_entities_response")
    plain = ("indirect_injection_detected", "rag_poisoning_detected", "rag_poisoning_score", "tool_exfiltration_detected", "tool_policy_violation_detected", "cross_agent_injection_detected", "image_injection_detected", "semantic_attack_score", "security_risk_level", "security_risk_score", "should_block")
    return x.select("conv_id", "turn", *plain, *map(joined, lists))


_GATE_SQL = f"""{_SCAN_SQL}, g AS (SELECT *, list_filter([CASE WHEN il > 0 THEN 'prompt_injection' END, CASE WHEN jl > 0 THEN 'jailbreak' END, CASE WHEN kl > 0 THEN 'skeleton_key' END, CASE WHEN len(types) > 0 THEN 'pii_detected' END, CASE WHEN len(named) + len(tokens) > 0 THEN 'secrets_detected' END], lambda x: x IS NOT NULL) AS kinds FROM roll),
d AS MATERIALIZED (SELECT *, CASE WHEN conv_id % 3 = 0 THEN list_filter(kinds, lambda k: k IN ('jailbreak', 'pii_detected')) ELSE kinds END AS counted FROM g),
b AS MATERIALIZED (SELECT *, len(counted) > 0 AND (rank = 3 OR (rank = 2 AND turn % 2 = 0)) AS block FROM d)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    categories = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("jailbreak"), F.lit("pii_detected")))
    return D.prompts(spark, sf_dir).withColumns({"block_threshold": F.when(F.col("turn") % 2 == 0, "medium").otherwise("high"), "block_categories": categories})


@query(f"WITH {_GATE_SQL} SELECT conv_id, turn, NOT block AS allow, CASE WHEN block THEN 'Blocked by traceguard: ' || array_to_string(counted, ', ') END AS block_reason, {O.level_name('rank')} AS risk_level, {O.join('kinds')} AS attack_types FROM b")
def sync_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync_check(_asked(spark, sf_dir)).select("conv_id", "turn", "allow", "block_reason", "risk_level", joined("attack_types"))


@query(f"""WITH {_GATE_SQL}, e AS (SELECT *, turn % 3 < 2 AS is_blank FROM b)
SELECT conv_id, turn, is_blank OR NOT block AS allow, CASE WHEN block AND NOT is_blank THEN 'Blocked by traceguard: ' || array_to_string(counted, ', ') END AS block_reason, CASE WHEN is_blank THEN 'clean' ELSE {O.level_name('rank')} END AS risk_level, CASE WHEN is_blank THEN '' ELSE {O.join('kinds')} END AS attack_types FROM e""")
def blank_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank prompts - white space of any kind, and none - are let through."""
    blank = F.when(F.col("turn") % 3 == 0, F.lit(" \t\n\u2003 ")).when(F.col("turn") % 3 == 1, F.lit("")).otherwise(F.col("prompt"))
    return sync_check(_asked(spark, sf_dir).withColumn("prompt", blank)).select("conv_id", "turn", "allow", "block_reason", "risk_level", joined("attack_types"))


_RESPONSE_SQL = f"""{PII_SQL}, k AS MATERIALIZED (SELECT *, {O.named_secrets('text')} AS named, {O.random_tokens('text')} AS tokens FROM x),
r AS MATERIALIZED (SELECT *, greatest({O.score_level('score')}, CASE WHEN len(named) > 0 THEN 3 WHEN len(tokens) > 0 THEN 2 ELSE 0 END) AS rank, greatest(score, CASE WHEN len(named) > 0 THEN 1.0 WHEN len(tokens) > 0 THEN 0.5 ELSE 0.0 END) AS total,
  array_to_string(list_filter([CASE WHEN len(types) > 0 THEN 'pii_in_response' END, CASE WHEN len(named) + len(tokens) > 0 THEN 'secrets_in_response' END], lambda x: x IS NOT NULL), ', ') AS kinds FROM k),
rb AS MATERIALIZED (SELECT *, (len(types) > 0 OR len(named) > 0) AND total >= 0.5 AS block FROM r)"""


@query(f"WITH {_RESPONSE_SQL} SELECT doc_id, block AS response_blocked, CASE WHEN block THEN 'Response blocked by traceguard: ' || kinds END AS block_reason, {O.level_name('rank')} AS risk_level, kinds AS attack_types FROM rb")
def response_gate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = response_gate(D.papers(spark, sf_dir).select("doc_id", F.col("text").alias("response")))
    return x.select("doc_id", "response_blocked", "block_reason", "risk_level", F.array_join("attack_types", ", ").alias("attack_types"))


@query(f"WITH {_RESPONSE_SQL} SELECT 'g' || doc_id AS key, block AS blocked, CASE WHEN block THEN 'Response blocked by traceguard: ' || kinds END AS reason, {O.level_name('rank')} AS level, false AS has_org FROM rb WHERE doc_id % 4 > 0")
def gate_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the response gate; requests without a correlation id get none."""
    asked = D.papers(spark, sf_dir).select(F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("g"), F.col("doc_id").cast("string"))).otherwise(F.lit("")).alias("correlation_id"), F.col("text").alias("response"))
    x = kafka.replies(response_gate(asked), GATE_RESULT, False)
    v = lambda path, kind: F.try_variant_get(F.parse_json("value"), path, kind)
    return x.select("key", v("$.result.response_blocked", "boolean").alias("blocked"), v("$.result.block_reason", "string").alias("reason"), v("$.result.risk_level", "string").alias("level"), F.coalesce(v("$.org_id", "string").isNotNull(), F.lit(False)).alias("has_org"))


@query("""WITH j AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN '' ELSE coalesce(text, '') END AS prompt, CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS response, turn % 2 = 0 AS gated FROM conversations)
SELECT conv_id || '-' || turn AS trace_id, CASE WHEN turn % 5 = 0 THEN conv_id || '-' || turn ELSE conv_id::VARCHAR END AS root_trace_id, prompt, CASE WHEN gated THEN '' ELSE response END AS response FROM j WHERE prompt <> '' OR response <> ''""")
def job_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs without text are dropped; a response that was gated before is not scanned again; a trace without root is its own."""
    c = D.table(spark, sf_dir, "conversations")
    event = F.to_json(F.struct(F.when(F.col("turn") % 4 == 0, F.lit("")).otherwise(F.col("text")).alias("input"), F.when(F.col("turn") % 3 == 0, F.lit("")).otherwise(F.col("role")).alias("output"), F.when(F.col("turn") % 5 > 0, F.col("conv_id").cast("string")).alias("root_trace_id")))
    jobs = c.select(F.lit("o").alias("organization_id"), F.concat_ws("-", "conv_id", "turn").alias("trace_id"), F.when(F.col("turn") % 2 == 0, F.lit(True)).alias("response_gated"), F.try_parse_json(event).alias("event"))
    return texts(jobs).select("trace_id", "root_trace_id", "prompt", "response")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN octet_length(encode(text)) <= 8388608 THEN md5(text) END AS body FROM documents")
def image_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline data of images, decoded; malformed data and images over the limit give nothing."""
    data = F.when(F.col("doc_id") % 3 == 0, F.lit("not base64!")).otherwise(F.base64(F.encode("text", "UTF-8")))
    image = F.array(F.struct(F.lit(None).cast("string").alias("url"), data.alias("data"), F.lit(None).cast("string").alias("mime")))
    return D.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.get(events.inline_bytes(image), 0)).alias("body"))


@query(f"""WITH {D.TRACES_SQL}, {D.SCANS_SQL}, s AS (SELECT organization_id, root_trace_id, count(*) AS scanned, max(security_risk_score) AS worst FROM scans GROUP BY ALL)
SELECT organization_id, root_trace_id, count(*) AS traces, count(*) FILTER (type = 'llm') AS llm, count(parent_id) AS linked, any_value(scanned) AS scanned, any_value(worst) AS worst FROM traces LEFT JOIN s USING (organization_id, root_trace_id) GROUP BY ALL""")
def stored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces stored as events alone and scans, written and read back: type and parent come from the event's JSON."""
    import uuid

    place = f"{D.shared_folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    fields = F.to_json(F.struct("type", "parent_id"))
    D.traces(spark, sf_dir).select("organization_id", "root_trace_id", "trace_id", fields.alias("event")).write.parquet(f"{place}/traces")
    D.scans(spark, sf_dir).write.parquet(f"{place}/scans")
    t = tables.read_traces(spark, f"{place}/traces").groupBy(*traces.KEY).agg(F.count("*").alias("traces"), F.count_if(F.col("type") == "llm").alias("llm"), F.count("parent_id").alias("linked"))
    s = tables.read_scans(spark, f"{place}/scans").groupBy(*traces.KEY).agg(F.count("*").alias("scanned"), F.max("security_risk_score").alias("worst"))
    return t.join(s, traces.KEY, "left")


@query(f"""WITH {_SCAN_SQL} SELECT (conv_id % 5)::VARCHAR AS organization_id, '' AS api_key_prefix, conv_id || '-' || turn AS trace_id, conv_id || '-' || turn AS root_trace_id, 'warn' AS mode, CASE WHEN il > 0 THEN 1 ELSE 0 END::TINYINT AS injection_detected,
  {O.join('named')} AS secret_types, '' AS rag_poisoning_sources, {O.level_name('rank')} AS security_risk_level, total AS security_risk_score, CASE WHEN rank = 3 THEN 1 ELSE 0 END::TINYINT AS should_block, 36500 AS retention_days, 37 AS columns FROM roll""")
def scan_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _scan(spark, sf_dir).withColumns({"organization_id": (F.col("conv_id") % 5).cast("string"), "trace_id": F.concat_ws("-", F.col("conv_id"), F.col("turn"))})
    x = tables.scan_rows(ids)
    return x.select("organization_id", "api_key_prefix", "trace_id", "root_trace_id", "mode", "injection_detected", joined("secret_types"), joined("rag_poisoning_sources"), "security_risk_level", "security_risk_score", "should_block", "retention_days", F.lit(len(x.columns)).alias("columns"))


@query(f"""WITH {_SCAN_SQL} SELECT (conv_id % 5)::VARCHAR AS key, 'enriched' AS kind, conv_id || '-' || turn AS trace_id, {O.level_name('rank')} AS level, total AS score, il > 0 AS injection FROM roll""")
def notification(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _scan(spark, sf_dir).withColumns({"organization_id": (F.col("conv_id") % 5).cast("string"), "api_key_prefix": F.lit("k"), "trace_id": F.concat_ws("-", F.col("conv_id"), F.col("turn")), "root_trace_id": F.lit(None).cast("string")})
    x = kafka.notifications(ids, [c for c in DETAILS if c in ids.columns])
    v = lambda path, kind: F.try_variant_get(F.parse_json("value"), path, kind)
    return x.select("key", v("$.kind", "string").alias("kind"), v("$.trace_id", "string").alias("trace_id"), v("$.security.security_risk_level", "string").alias("level"), v("$.security.security_risk_score", "double").alias("score"), v("$.security.injection_detected", "boolean").alias("injection"))


@query(f"WITH {_GATE_SQL} SELECT 'c' || conv_id || '-' || turn AS key, 'o' AS org, NOT block AS allow, {O.level_name('rank')} AS level FROM b WHERE turn % 4 <> 3")
def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir).withColumns({"correlation_id": F.when(F.col("turn") % 4 != 3, F.concat(F.lit("c"), F.concat_ws("-", F.col("conv_id"), F.col("turn")))), "org_id": F.lit("o")})
    x = kafka.replies(sync_check(asked), CHECK_RESULT, True)
    v = lambda path, kind: F.try_variant_get(F.parse_json("value"), path, kind)
    return x.select("key", v("$.org_id", "string").alias("org"), v("$.result.allow", "boolean").alias("allow"), v("$.result.risk_level", "string").alias("level"))


@query("SELECT (conv_id % 5)::VARCHAR AS organization_id, conv_id || '-' || turn AS trace_id, 'clean' AS security_risk_level, 0.0::DOUBLE AS security_risk_score, 0::TINYINT AS should_block, true AS scan_failed FROM conversations")
def scan_failed_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.table(spark, sf_dir, "conversations").select((F.col("conv_id") % 5).cast("string").alias("organization_id"), F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("trace_id"))
    return tables.failure_rows(c).select("organization_id", "trace_id", "security_risk_level", "security_risk_score", "should_block", "extra.scan_failed")


@query(f"WITH {D.SCANS_SQL} SELECT trace_id FROM scans WHERE ingested_at + 86400 * (ingested_at % 40) >= 1000000")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.scans(spark, sf_dir).withColumn("retention_days", (F.unix_timestamp("ingested_at") - 1_700_000_000) % 40)
    return tables.retained(s.withColumn("retention_days", F.col("retention_days").cast("int")), F.timestamp_seconds(F.lit(1_701_000_000))).select("trace_id")


_POST_SQL = f"""{_CHAIN_SQL}, p AS (SELECT t.trace_id, s.security_risk_score AS v, row_number() OVER (PARTITION BY t.trace_id ORDER BY s.ingested_at DESC, s.trace_id DESC) AS n
  FROM traces t JOIN scans s ON s.organization_id = t.organization_id AND s.root_trace_id = t.root_trace_id AND s.trace_id <> t.trace_id WHERE t.type = 'llm'),
past AS (SELECT trace_id, list(v ORDER BY n DESC) AS history FROM p WHERE n <= 19 GROUP BY trace_id),
j AS (SELECT *, {D.plant_sql('output', 'trace_id::BIGINT')} AS prompt FROM traces WHERE type = 'llm'), n AS MATERIALIZED (SELECT organization_id, root_trace_id, trace_id, parent_id, prompt, {O.normalized('prompt')} AS t FROM j), {_ROLL_SQL},
first_ AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY organization_id, root_trace_id ORDER BY trace_id) AS nth FROM traces WHERE type IN ('tool', 'function', 'vectorstore')),
sib AS MATERIALIZED (SELECT organization_id, root_trace_id, trace_id, {O.normalized("coalesce(CASE WHEN type <> 'vectorstore' THEN output ELSE doc END, '')")} AS t, {O.entities("coalesce(input, '')")} AS sent FROM first_ WHERE nth <= 51),
hit AS MATERIALIZED (SELECT *, len({O.strong('t', _INJ)}) + len({O.strong('t', _JB)}) > 0 AS bad FROM sib),
beside AS (SELECT r.trace_id, h.bad, h.sent, row_number() OVER (PARTITION BY r.trace_id ORDER BY h.trace_id) AS k FROM roll r JOIN hit h ON h.organization_id = r.organization_id AND h.root_trace_id = r.root_trace_id AND h.trace_id <> r.trace_id),
near AS (SELECT trace_id, bool_or(bad) AS indirect, list_sort(list_distinct(flatten(list(sent)))) AS sent FROM beside WHERE k <= 50 GROUP BY trace_id),
w AS (SELECT r.*, coalesce(indirect, false) AS indirect, coalesce(sent, []) AS sent, coalesce(q.type = 'llm', false) AS from_llm, coalesce(history, []) AS history, e.chain
  FROM roll r LEFT JOIN near USING (trace_id) LEFT JOIN past USING (trace_id) JOIN ended e ON e.trace_id = r.trace_id AND e.n = 1 LEFT JOIN traces q ON q.trace_id = r.parent_id AND q.organization_id = r.organization_id AND q.root_trace_id = r.root_trace_id),
v AS MATERIALIZED (SELECT *, from_llm AND (il > 0 OR jl > 0) AS crossed FROM w),
z AS MATERIALIZED (SELECT *, greatest(rank, CASE WHEN indirect OR crossed THEN 3 WHEN len(sent) > 0 THEN 2 ELSE 0 END) AS level, round(greatest(total, CASE WHEN indirect OR crossed THEN 1.0 WHEN len(sent) > 0 THEN 0.5 ELSE 0.0 END), 4) AS score FROM v),
y AS MATERIALIZED (SELECT *, list_append(history, score) AS turns, list_append(chain, score) AS line FROM z), x AS MATERIALIZED (SELECT *, {O.slope('turns')} AS rise, {O.slope('line')} AS climb FROM y)"""


@query(f"""WITH RECURSIVE {_POST_SQL} SELECT trace_id, root_trace_id, {O.level_name('level')} AS security_risk_level, score AS security_risk_score, level = 3 AS should_block, {O.join('sent')} AS tool_exfiltration_types, len(turns) AS session_turns, round(rise, 4) AS crescendo_score,
  rise >= 0.3 AND len(turns) >= 3 AND score >= 0.25 AS crescendo_detected, len(line) AS agent_chain_depth, from_llm AND climb >= 0.3 AND len(line) >= 3 AND score >= 0.25 AS trust_boundary_escalation, round(climb, 4) AS escalation_score FROM x""")
def post_call_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan over derived traces."""
    t, s = D.traces(spark, sf_dir), D.scans(spark, sf_dir)
    prompt = D.plant(F.get_json_object("event", "$.output"), F.col("trace_id").cast("long"))
    jobs = t.where("type = 'llm'").select("organization_id", "trace_id", F.try_parse_json(F.to_json(F.struct(prompt.alias("input"), "root_trace_id", "parent_id"))).alias("event"))
    x = post_call(jobs, t, s)
    long = lambda c: F.col(c).cast("long").alias(c)
    return x.select("trace_id", "root_trace_id", "security_risk_level", "security_risk_score", "should_block", joined("tool_exfiltration_types"), long("session_turns"), "crescendo_score", "crescendo_detected", long("agent_chain_depth"), "trust_boundary_escalation", "escalation_score")


@query()
def stream_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pre-call gate as a stream over files; tests hold it against the batch form."""
    import uuid

    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    out = f"{D.shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*conversations*").parquet(sf_dir)
    asked = rows.select("conv_id", "turn", D.plant(F.col("text"), F.col("conv_id") * 8 + F.col("turn")).alias("prompt"))
    checked = S.check(asked).select("conv_id", "turn", "allow", "risk_level")
    q = checked.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("conv_id long, turn long, allow boolean, risk_level string").parquet(f"{out}/rows")


@query("""WITH l AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN turn - 1 END AS before FROM conversations) SELECT conv_id, count(*) AS turns, count(before) AS linked FROM l GROUP BY conv_id""")
def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type and parent_id read from the event's JSON where a table lacks the columns."""
    c = D.table(spark, sf_dir, "conversations").withColumn("e", V.parse(F.to_json(F.struct(F.when(F.col("turn") > 0, F.col("turn") - 1).cast("string").alias("parent_id")))))
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count(V.string(V.at(F.col("e"), "parent_id"))).alias("linked"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pre-call check of every prompt that users control."""
    asked = D.prompts(spark, sf_dir).where(~F.col("role").isin(*events.UNSCANNED_ROLES))
    order = Window.partitionBy("conv_id").orderBy("turn")
    return S.check(asked).withColumn("nth", F.row_number().over(order)).select("conv_id", "turn", "nth", "allow", "block_reason", "risk_level", "attack_types")
