"""Registered queries of records: preparation, the whole screen, Unicode analysis, sessions, merges, sinks; each with the SQL of the same rows where SQL has it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlens.functions import patterns as P
from promptlens.functions import screen as S
from promptlens.functions import text as T
from promptlens.functions import unicode as U
from promptlens.operators import corpus, media, orchestrate, outputs, prepare, screening, sessions
from promptlens.operators import records as R
from promptlens.queries import CHUNKS, HEUR, INV, KEY, ORACLE, QUERIES, RUNS, SEED, V, WITH, ZW, hmac_sql, like, query, quoted, sanitized_sql, seeded, table



TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
NORMAL = lambda x: TRIM.format(f"replace(regexp_replace(regexp_replace({x}, ' +', ' ', 'g'), '\\n\\n+', chr(10), 'g'), chr(9), ' ')")
TOKENS = lambda x: f"length(trim(regexp_replace({x}, '\\s+', ' ', 'g')))//4"

# Odd characters that NFKC changes, put where the row's id says.
ODD = "CASE doc_id % 5 WHEN 0 THEN 'ＡＢ' || text WHEN 1 THEN text || 'ﬁ' WHEN 2 THEN text || '​①' WHEN 3 THEN ' ' || text ELSE text END"
ODD_CLEAN = "replace(replace(t, '​', ''), ' ', '')"
ODD_NFKC = f"replace(replace(replace(replace({ODD_CLEAN}, 'Ａ', 'A'), 'Ｂ', 'B'), 'ﬁ', 'fi'), '①', '1')"


def odd(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").withColumn("t", F.expr(ODD))


@query(
    f"""WITH o AS (SELECT doc_id, {ODD} AS t FROM documents), a AS (SELECT *, {ODD_CLEAN} AS c, {ODD_NFKC} AS n FROM o),
b AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS changes, len(regexp_extract_all(t, {ZW})) AS z, len(regexp_extract_all(t, {INV})) AS i FROM a)
SELECT doc_id, CAST(changes AS BIGINT) AS changes, CASE doc_id % 5 WHEN 0 THEN 'changed_positions=2,samples=[pos0:''Ａ''=>''A'',pos1:''Ｂ''=>''B'']'
 WHEN 1 THEN 'changed_positions=1,length_diff=1,samples=[pos'||(length(c)-1)||':''ﬁ''=>''f'']' WHEN 2 THEN 'changed_positions=1,samples=[pos'||(length(c)-1)||':''①''=>''1'']' ELSE 'no_changes' END AS diff,
 z > 0 OR i > 0 OR changes > 5 OR coalesce(changes / nullif(length(t), 0), 0) > 0.05 AS obfuscated, md5(n) AS normalized FROM b"""
)
def q43_unicode_analysis(spark, sf):
    own = U.with_unicode(odd(spark, sf), "t")
    return own.select("doc_id", F.col("normalization_changes").cast("long").alias("changes"), F.col("unicode_diff").alias("diff"), F.col("unicode_obfuscation_flag").alias("obfuscated"), F.md5("normalized_text").alias("normalized"))


STRICT = "CASE doc_id % 4 WHEN 0 THEN 'ае' || text WHEN 1 THEN text || '‮‎' WHEN 2 THEN '​Ａ' || text ELSE text END"


@query(
    f"""WITH o AS (SELECT doc_id, {STRICT} AS t FROM documents), a AS (SELECT *, replace(replace(t, '​', ''), 'Ａ', 'A') AS c FROM o),
u AS (SELECT doc_id, c, generate_subscripts(string_split(t,''),1)-1 AS i, unnest(string_split(t,'')) AS x, string_split(c,'') AS cs, length(c) AS n, t FROM a WHERE doc_id % 4 = 2),
d AS (SELECT doc_id, count(*) AS k FROM u WHERE i < n AND x <> cs[i+1] GROUP BY doc_id)
SELECT doc_id, md5(c) AS clean, CAST(CASE WHEN doc_id % 4 = 2 THEN coalesce(k, 0) + 1 ELSE 0 END AS BIGINT) AS changes, CAST(CASE WHEN doc_id % 4 = 1 THEN 2 ELSE 0 END AS BIGINT) AS invisible,
 (doc_id % 4 = 1) OR (doc_id % 4 = 2 AND coalesce(k, 0) + 1 > 3) AS obfuscated FROM a LEFT JOIN d USING(doc_id)"""
)
def q44_unicode_strict_clean(spark, sf):
    own = U.with_clean(table(spark, sf, "documents").withColumn("t", F.expr(STRICT)), "t")
    return own.select("doc_id", F.md5("clean_text").alias("clean"), F.col("normalization_changes").cast("long").alias("changes"), F.col("invisible_count").cast("long").alias("invisible"), F.col("unicode_obfuscation_flag").alias("obfuscated"))


@query(
    f"""WITH o AS (SELECT doc_id, {STRICT} AS t FROM documents) SELECT doc_id % 4 AS kind, CAST(sum(len(regexp_extract_all(t, '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]'))) AS BIGINT) AS z, CAST(sum(CASE WHEN doc_id % 4 = 1 THEN 2 ELSE 0 END) AS BIGINT) AS i,
CAST(sum(CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS h FROM o GROUP BY 1"""
)
def q45_unicode_strict_mask(spark, sf):
    own = table(spark, sf, "documents").withColumn("t", F.expr(STRICT)).withColumn("m", U.strict_mask(F.col("t")))
    n = lambda ch: F.sum(F.regexp_count("m", F.lit(ch))).cast("long")
    return own.groupBy((F.col("doc_id") % 4).alias("kind")).agg(n("Z").alias("z"), n("I").alias("i"), n("H").alias("h"))


def requests(spark, sf) -> DataFrame:
    """A request of each conversation: its first turn is the prompt, the later ones external texts, files and history."""
    c = table(spark, sf, "conversations")
    later = lambda r: F.transform(F.array_sort(F.collect_list(F.when((F.col("turn") > 0) & (F.col("turn") % 3 == r), F.struct("turn", "text")))), lambda x: x["text"])
    own = c.groupBy("conv_id").agg(F.min(F.when(F.col("turn") == 0, F.col("text"))).alias("user_prompt"), later(1).alias("external"), later(2).alias("_f"), F.max(F.when(F.col("turn") == 3, F.col("text"))).alias("conversation"))
    files = F.transform("_f", lambda x, i: F.struct(x.alias("content"), F.lit("a.txt").alias("source"), i.alias("chunk_id")))
    return own.withColumns({"files": files, "request_id": F.concat(F.lit("request-"), F.col("conv_id").cast("string"))}).drop("_f")


REQUESTS = f"""WITH q AS (SELECT conv_id, min(text) FILTER (turn = 0) AS p, max(text) FILTER (turn = 3) AS talk FROM conversations GROUP BY 1),
x AS (SELECT conv_id, 0 AS src, turn AS o, CASE WHEN turn = 3 THEN '[CONVERSATION]'||text||'[/CONVERSATION]' END AS d, text AS bare FROM conversations WHERE turn = 3 AND {TRIM.format('text')} <> ''
 UNION ALL SELECT conv_id, 1, turn, '[EXTERNAL]'||text||' [Source: a.txt, Chunk: '||(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)||'][/EXTERNAL]', text||' [Source: a.txt, Chunk: '||(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)||']' FROM conversations WHERE turn > 0 AND turn % 3 = 2
 UNION ALL SELECT conv_id, 2, turn, '[EXTERNAL]'||text||'[/EXTERNAL]', text FROM conversations WHERE turn > 0 AND turn % 3 = 1 AND {TRIM.format('text')} <> ''),
g AS (SELECT conv_id, list(d ORDER BY src, o) AS chunks, list({hmac_sql('bare')} ORDER BY src, o) AS hmacs, sum({TOKENS('d')}) AS tok FROM x GROUP BY 1),
f AS (SELECT conv_id, count(*) AS nf, sum(length(text)) AS cf FROM conversations WHERE turn > 0 AND turn % 3 = 2 GROUP BY 1),
r AS (SELECT q.conv_id, p, {NORMAL("coalesce(p, '')")} AS u, coalesce(chunks, []) AS chunks, coalesce(hmacs, []) AS hmacs, coalesce(tok, 0) AS tok, coalesce(nf, 0) AS nf, coalesce(cf, 0) AS cf FROM q LEFT JOIN g USING(conv_id) LEFT JOIN f USING(conv_id)),
s AS (SELECT *, CASE WHEN p IS NULL OR {TRIM.format('p')} = '' THEN 'empty prompt' WHEN length(p) > 50000 THEN 'prompt too long' END AS error, array_to_string(chunks, ' ') AS joined FROM r),
t AS (SELECT *, length(u) + length(joined) AS chars, {TOKENS('u')} + tok AS tokens, CASE WHEN length(u) + length(joined) = 0 THEN 0.0 WHEN length(joined) = 0 THEN 1.0 ELSE round(length(u)::DOUBLE / (length(u) + length(joined)), 3) END AS ratio FROM s) """


def prepared(spark, sf) -> DataFrame:
    return prepare.prepare_text(requests(spark, sf), KEY)


@query(REQUESTS + "SELECT conv_id, CASE WHEN error IS NULL THEN u ELSE 'ERROR: '||error END AS normalized_user, CASE WHEN error IS NULL THEN md5(array_to_string(chunks, '|')) ELSE md5('') END AS external, CASE WHEN error IS NULL THEN md5(array_to_string(hmacs, '|')) ELSE md5('') END AS hmacs, CAST(CASE WHEN error IS NULL THEN chars ELSE 0 END AS BIGINT) AS char_total, CAST(CASE WHEN error IS NULL THEN tokens ELSE 0 END AS BIGINT) AS token_estimate, CAST(CASE WHEN error IS NULL THEN ratio ELSE 0 END AS DOUBLE) AS ratio, CAST(CASE WHEN error IS NULL THEN nf ELSE 0 END AS BIGINT) AS files, CAST(CASE WHEN error IS NULL THEN cf ELSE 0 END AS BIGINT) AS extracted, error IS NULL AND len(chunks) > 0 AS rag FROM t")
def q46_prepare_text(spark, sf):
    p, joined = F.col("prepared_input.text_embed_stub"), lambda c: F.md5(F.array_join(c, "|"))
    stats = p["stats"]
    return prepared(spark, sf).select("conv_id", p["normalized_user"].alias("normalized_user"), joined(p["normalized_external"]).alias("external"), joined(p["hmacs"]).alias("hmacs"), stats["char_total"].alias("char_total"), stats["token_estimate"].alias("token_estimate"), stats["user_external_ratio"].alias("ratio"), stats["file_chunks_count"].alias("files"), stats["extracted_total_chars"].alias("extracted"), F.col("prepared_input.metadata.rag_enabled").alias("rag"))


@query(REQUESTS + "SELECT conv_id, CASE WHEN error IS NULL THEN 'Request: request-'||conv_id||' | Time: 0.00ms | Tokens: '||CAST(tokens AS BIGINT)||' | Chars: '||CAST(chars AS BIGINT)||' | External chunks: '||len(chunks)||' | RAG: '||CASE WHEN len(chunks)>0 THEN 'Yes' ELSE 'No' END||' | File: '||CASE WHEN nf>0 THEN 'Yes' ELSE 'No' END||' | Media: No | Emojis: 0' ELSE 'Request: request-'||conv_id||' | Time: 0.00ms | Tokens: 0 | Chars: 0 | External chunks: 0 | RAG: No | File: No | Media: No | Emojis: 0' END AS summary, CASE WHEN error IS NULL AND u = '' THEN 'Empty user input' ELSE 'ok' END AS fault FROM t")
def q47_payload_summary_and_faults(spark, sf):
    p = F.col("prepared_input")
    return prepared(spark, sf).select("conv_id", prepare.payload_summary(p).alias("summary"), F.coalesce(prepare.payload_error(p), F.lit("ok")).alias("fault"))


@query(REQUESTS + ", c AS (SELECT *, round(least(10.0::DOUBLE, least(tokens/100::DOUBLE,3.0)+least(len(chunks)/5::DOUBLE,3.0)+abs(ratio-0.5)*4+least(nf/5::DOUBLE,2.0)),2) AS score FROM t) SELECT conv_id, score::DOUBLE AS score, CASE WHEN score < 2 THEN 'Simple input' WHEN score < 4 THEN 'Moderate complexity' WHEN score < 6 THEN 'Complex input' WHEN score < 8 THEN 'Highly complex input' ELSE 'Very complex input with extensive external data' END AS meaning, CAST(CASE WHEN len(chunks)=0 THEN 0 ELSE round((length(joined)-len(chunks)+1)::DOUBLE/len(chunks),2) END AS DOUBLE) AS mean_chunk, printf('Total: %d chars, ~%d tokens | User/External ratio: %.1f%% | File chunks: %d (%d chars)', CAST(chars AS BIGINT), CAST(tokens AS BIGINT), ratio::DOUBLE*100, CAST(nf AS BIGINT), CAST(cf AS BIGINT)) AS summary FROM c")
def q48_complexity_and_token_summary(spark, sf):
    own = prepare.parsed(requests(spark, sf)).withColumn("_c", prepare.context(F.col("conversation"), F.col("files"), F.col("external"), F.col("retrieved"), KEY)).withColumn("chunks", F.transform("_c", lambda x: x["delimited"]))
    extracted = F.aggregate("files", F.lit(0).cast("long"), lambda s, f: s + F.length(f["content"]))
    own = own.withColumn("stats", prepare.statistics(T.normalize(F.col("user_prompt")), F.col("chunks"), F.size("files"), extracted))
    own = own.withColumn("x", prepare.complexity(F.col("chunks"), F.col("stats")))
    return own.select("conv_id", F.col("x.complexity_score").alias("score"), F.col("x.interpretation").alias("meaning"), F.col("x.avg_chunk_size").alias("mean_chunk"), prepare.statistics_summary(F.col("stats")).alias("summary"))


SCORE = " + ".join(f"CASE WHEN {f} THEN {w} ELSE 0.0 END" for f, w in (("f1", 0.2), ("f2", 0.3), ("coalesce(m.n,0)>=20", 0.1), ("f4", 0.15), ("f5", 0.1), ("f6", 0.15), ("f7", 0.4), ("f8", 0.2)))
BOTH = V.replace(f"{SEED} AS t", f"coalesce({SEED}, '')||' '||coalesce(lang, '') AS t")


@query(BOTH + HEUR + ", " + RUNS + f" SELECT doc_id, round((least(1.0, {SCORE})::DOUBLE)*0.7 + CASE WHEN regexp_matches(v.t, {ZW}) OR regexp_matches(v.t, {INV}) THEN 0.3 ELSE 0 END, 4)::DOUBLE AS score, round(least(1.0, {SCORE})::DOUBLE, 4) > 0.3 AS suspicious FROM h LEFT JOIN m USING(doc_id) JOIN v USING(doc_id)")
def q49_layer0_output(spark, sf):
    own = seeded(spark, sf).withColumn("external", F.array(F.coalesce("lang", F.lit(""))))
    own = prepare.with_layer0(own, "t", "external")
    return own.select("doc_id", F.round("suspicious_score", 4).alias("score"), S.is_suspicious(F.round("heuristic_flags.suspicious_score", 4)).alias("suspicious"))


def two_channels(spark, sf) -> DataFrame:
    """Every third document has no user text, every third no external one."""
    own = seeded(spark, sf).select("doc_id", "c", F.lit(0.4).alias("upstream_score"), F.col("doc_id").cast("string").alias("request_id"))
    k = F.col("doc_id") % 3
    return own.select("doc_id", "request_id", "upstream_score", F.when(k == 0, F.lit("")).otherwise(F.col("c")).alias("clean_user"), F.when(k == 1, F.lit("")).otherwise(F.col("c")).alias("clean_external"))


@query(WITH + "SELECT doc_id, block IS NOT NULL AS blocked, CASE WHEN block IS NOT NULL THEN 'Matched block pattern: '||block ELSE 'none' END AS reason, CASE WHEN block IS NOT NULL THEN '' ELSE array_to_string(list_sort(flags), ',') END AS signatures, CAST(CASE WHEN block IS NOT NULL THEN 2 WHEN len(flags)>=3 THEN 2 ELSE 1 END AS BIGINT) AS severity, verdict FROM z")
def q50_screen_record(spark, sf):
    own = screening.screen(two_channels(spark, sf))
    return own.select("doc_id", "blocked", F.coalesce("reason", F.lit("none")).alias("reason"), F.array_join("threat_signatures", ",").alias("signatures"), F.col("severity").cast("long").alias("severity"), "verdict")


@query(WITH + f"SELECT doc_id, CASE WHEN block IS NOT NULL THEN '[\"block:'||block||'\"]' WHEN len(flags)=0 THEN '[]' ELSE '[\"'||array_to_string(list_sort(flags), '\",\"')||'\"]' END AS ids, {hmac_sql(chr(99) + chr(99))} AS hmac FROM (SELECT *, CASE WHEN doc_id % 3 = 2 THEN trim(c||' '||c) ELSE c END AS cc FROM z)")
def q51_audit_rows(spark, sf):
    own = screening.audit(screening.screen(two_channels(spark, sf)), KEY)
    return own.select(F.col("request_id").cast("long").alias("doc_id"), F.col("matched_rule_ids").alias("ids"), F.col("raw_text_hmac").alias("hmac"))


@query(WITH + "SELECT block AS rule_id, CAST(count(*) AS BIGINT) AS n, min(lower(regexp_extract(c, CASE block " + " ".join(f"WHEN '{i}' THEN {quoted(('(?i)' if ci else '') + p)}" for i, p, ci in P.BLOCK) + " END))) AS least FROM z WHERE block IS NOT NULL GROUP BY block")
def q52_block_matched_text(spark, sf):
    own = seeded(spark, sf).select(S.block_match(F.col("c")).alias("m")).where("m is not null")
    return own.groupBy("m.rule_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.lower("m.matched_text")).alias("least"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {sanitized_sql('t')} ELSE {sanitized_sql('t')} END AS clean_user, CASE WHEN doc_id % 2 = 0 THEN 'x y' ELSE '' END AS clean_external, CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE doc_id::VARCHAR END AS request_id FROM (SELECT *, {SEED} AS t FROM documents)")
def q53_channels_and_metadata(spark, sf):
    """Records of which every second has no text of its own, so that the analysed text stands in."""
    t, even = F.col("t"), F.col("doc_id") % 2 == 0
    none = F.array().cast("array<string>")
    stub = F.struct(F.when(even, t).alias("normalized_user"), F.when(even, F.array(F.lit("x"), F.lit("[EXTERNAL]y[/EXTERNAL]"))).otherwise(none).alias("normalized_external"), F.lit(None).cast("array<string>").alias("emoji_descriptions"))
    about = F.struct(F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("string")).alias("request_id"), F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("timestamp"))
    layer0 = F.struct(t.alias("normalized_text"), F.struct(F.lit(0.1).alias("suspicious_score")).alias("heuristic_flags"))
    own = seeded(spark, sf).withColumn("prepared_input", F.struct(stub.alias("text_embed_stub"), about.alias("metadata"), layer0.alias("layer0")))
    user, external = screening.channels()
    return own.select("doc_id", user.alias("clean_user"), external.alias("clean_external"), screening.metadata()["request_id"].alias("request_id"))


@query(f"SELECT conv_id, count(*) AS n, md5(string_agg({hmac_sql('text')}, ',' ORDER BY turn)) AS signatures, CAST(count(*) FILTER (turn <> 1) AS BIGINT) AS valid, count(*) FILTER (false) AS unequal FROM conversations GROUP BY conv_id")
def q54_sign_and_verify_lists(spark, sf):
    own = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    own = own.withColumn("signed", T.sign_all(F.col("texts"), KEY))
    tampered = F.transform("texts", lambda x, i: F.when(i == 1, F.concat(x, F.lit("!"))).otherwise(x))
    count = lambda flags: F.size(F.filter(flags, lambda x: x)).cast("long")
    return own.select("conv_id", F.size("texts").cast("long").alias("n"), F.md5(F.array_join("signed", ",")).alias("signatures"), count(T.verify_all(tampered, F.col("signed"), KEY)).alias("valid"), count(T.verify_all(F.col("texts"), F.slice("signed", 2, 100), KEY)).alias("unequal"))


MARKED = "CASE turn % 4 WHEN 0 THEN '[EXTERNAL]'||text||'[/EXTERNAL]' WHEN 1 THEN ' [CONVERSATION]'||text||'[/CONVERSATION]'||chr(10) WHEN 2 THEN '[EXTERNAL]'||text ELSE text||'[/CONVERSATION]' END"


@query(f"SELECT conv_id, turn, md5({TRIM.format('text')}) AS bare, CASE WHEN text = {TRIM.format('text')} THEN true ELSE NULL END AS verified FROM conversations")
def q55_remove_delimiters(spark, sf):
    own = table(spark, sf, "conversations").withColumn("m", F.expr(MARKED))
    bare = T.undelimit(F.col("m"))
    ok = T.verify_chunk(F.col("m"), T.hmac_sha256(F.col("text"), KEY), KEY)
    return own.select("conv_id", "turn", F.md5(T.strip(bare)).alias("bare"), F.when(F.col("text") == T.strip(F.col("text")), ok).alias("verified"))


@query(CHUNKS + f", c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY st) - 1 AS i, content FROM o) SELECT doc_id, md5(string_agg('[EXTERNAL]'||content||' [Source: '||doc_id||', Chunk: '||i||'][/EXTERNAL]', '|' ORDER BY i)) AS delimited, md5(string_agg({hmac_sql(chr(120))}, '|' ORDER BY i)) AS hmacs FROM (SELECT *, content||' [Source: '||doc_id||', Chunk: '||i||']' AS x FROM c) GROUP BY doc_id")
def q56_file_chunk_context(spark, sf):
    rows = R.chunk(table(spark, sf, "documents"), "doc_id", "text").where(F.length("content") > 0)
    signed = rows.select("doc_id", "chunk_id", T.sign_chunk(prepare.file_chunk(F.col("content"), F.col("doc_id"), F.col("chunk_id")), KEY).alias("s"))
    part = lambda name: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", f"s.{name}"))), lambda x: x[name]), "|")).alias(name)
    return signed.groupBy("doc_id").agg(part("delimited"), part("hmac").alias("hmacs"))


def messages(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"), F.when(F.col("event_type") == "view", "user").otherwise("system").alias("role"), F.col("event_type").alias("content"), "ts", F.col("event_id").alias("turn"))


LAST = "WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events), s AS (SELECT user_id::VARCHAR AS session_id, count(*) FILTER (n <= 20) AS message_count, max(ts) AS last_access, min(ts) AS created_at, string_agg(CASE WHEN event_type = 'view' THEN 'User: ' ELSE 'Assistant: ' END || event_type, chr(10) ORDER BY n DESC) FILTER (n <= 5) AS history FROM k GROUP BY 1), m AS (SELECT max(ts) AS now FROM events) "


def session_table(spark, sf) -> DataFrame:
    return sessions.session_records(messages(spark, sf))


@query(LAST + "SELECT session_id, CAST(message_count AS BIGINT) AS message_count, md5('Previous conversation context:'||chr(10)||history) AS context FROM s")
def q57_session_context(spark, sf):
    return session_table(spark, sf).select("session_id", F.col("message_count").cast("long").alias("message_count"), F.md5(sessions.for_context(F.col("messages"))).alias("context"))


@query(LAST + "SELECT session_id, round(epoch(now) - epoch(last_access), 0)::BIGINT AS idle, epoch(now) - epoch(last_access) > 3600 AS expired FROM s, m")
def q58_session_idle_and_expiry(spark, sf):
    now = table(spark, sf, "events").agg(F.max("ts").alias("now"))
    own = session_table(spark, sf).crossJoin(F.broadcast(now))
    idle = sessions.with_idle(own, F.col("now")).select("session_id", F.round("inactive_seconds", 0).cast("long").alias("idle"))
    gone = sessions.expired(own, F.col("now")).select("session_id", F.lit(True).alias("expired"))
    return idle.join(gone, "session_id", "left").withColumn("expired", F.coalesce("expired", F.lit(False)))


@query(LAST + "SELECT session_id, CAST(CASE WHEN session_id::BIGINT % 5 = 1 THEN 0 ELSE message_count END AS BIGINT) AS message_count FROM s WHERE session_id::BIGINT % 7 <> 0")
def q59_session_delete_and_clear(spark, sf):
    own = session_table(spark, sf)
    ids = own.select("session_id", F.col("session_id").cast("long").alias("i"))
    left = sessions.cleared(sessions.deleted(own, ids.where("i % 7 = 0")), ids.where("i % 5 = 1"))
    return sessions.listed(left).select("session_id", F.col("message_count").cast("long").alias("message_count"))


@query(LAST + "SELECT count(*) AS sessions, CAST(sum(message_count) AS BIGINT) AS messages, round(avg(message_count), 2) AS mean FROM s")
def q60_session_table_stats(spark, sf):
    return sessions.stats(session_table(spark, sf)).select("sessions", F.col("messages").cast("long").alias("messages"), "mean")


@query("WITH k AS (SELECT * FROM events WHERE user_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20) SELECT user_id::VARCHAR AS session_id, count(*) AS n, (SELECT count(*) FROM events WHERE user_id % 3 = 0 AND event_id % 2 = 1) AS refused FROM k GROUP BY 1")
def q61_session_add(spark, sf):
    """Odd events come in new; sessions whose number three divides are unknown, and refused."""
    own = messages(spark, sf)
    known = own.select("session_id").distinct().where("cast(session_id as long) % 3 <> 0")
    held = own.where("turn % 2 = 0 and cast(session_id as long) % 3 <> 0")
    added, refused = sessions.add_messages(known, held, own.where("turn % 2 = 1"))
    return added.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(refused.agg(F.count(F.lit(1)).alias("refused"))))


def corpus_records(spark, sf) -> DataFrame:
    """Benchmark items as plain questions, documents as attacks; every third has another document's text as its plain query."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("row"), F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.lit(" Hate Speech ").alias("policy"), F.lit(None).cast("string").alias("from"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("row"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("jailbreak_query"), F.expr("CASE WHEN doc_id % 3 = 0 THEN replace(text, 'e', 'E') WHEN doc_id % 3 = 1 THEN 'plain ' || doc_id % 10 ELSE text END").alias("redteam_query"), F.lit("Other Case").alias("policy"), F.col("source").alias("from"), F.when(F.col("doc_id") % 2 == 0, "Logic").alias("format"))
    return corpus.merged(corpus.direct_records(b, 0), corpus.jailbreak_records(d, 1, "jailbreak"))


MERGE = f"""WITH b AS (SELECT 0 AS rank, item_id AS row, 0 AS sub, 'redteam_'||item_id AS id, {TRIM.format("coalesce(text,'')")} AS text, 'hate_speech' AS category, 'RedTeam' AS source, 'direct' AS type, false AS jail, NULL AS query FROM benchmark),
e AS (SELECT *, {TRIM.format("coalesce(text,'')")} AS a, {TRIM.format("coalesce(CASE WHEN doc_id % 3 = 0 THEN replace(text, 'e', 'E') WHEN doc_id % 3 = 1 THEN 'plain ' || doc_id % 10 ELSE text END, '')")} AS p FROM documents),
u AS (SELECT * FROM b UNION ALL SELECT 1, doc_id, 0, 'jailbreak_'||doc_id, a, 'other_case', coalesce(source, 'JailBreakV'), CASE WHEN doc_id % 2 = 0 THEN 'logic' ELSE 'template' END, true, CASE WHEN p <> a THEN p END FROM e WHERE a <> ''
 UNION ALL SELECT 1, doc_id, 1, 'jailbreak_clean_'||doc_id, p, 'other_case', coalesce(source, 'JailBreakV'), 'direct', false, NULL FROM e WHERE a <> '' AND p <> '' AND p <> a),
f AS (SELECT *, substr(md5(lower(text)),1,12) AS key FROM u WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY substr(md5(lower(text)),1,12) ORDER BY rank, row, sub) = 1) """


@query(MERGE + "SELECT key, id, category, source, type, jail AS is_jailbreak, md5(coalesce(query, 'none')) AS original_query FROM f")
def q62_merged_corpus(spark, sf):
    return corpus_records(spark, sf).select("key", "id", "category", "source", "type", "is_jailbreak", F.md5(F.coalesce("original_query", F.lit("none"))).alias("original_query"))


@query(MERGE + "SELECT CASE WHEN grouping(category)=0 THEN 'category' WHEN grouping(type)=0 THEN 'type' WHEN grouping(source)=0 THEN 'source' ELSE 'all' END AS dimension, coalesce(category, type, source, 'all') AS value, count(*) AS n, CAST(count(*) FILTER (jail) AS BIGINT) AS jailbreaks FROM f GROUP BY GROUPING SETS ((category),(type),(source),())")
def q63_corpus_stats(spark, sf):
    return corpus.corpus_stats(corpus_records(spark, sf)).select("dimension", "value", "n", F.col("jailbreaks").cast("long").alias("jailbreaks"))


@query(WITH + "SELECT source, CAST(count(*) FILTER (verdict='blocked') AS BIGINT) AS blocked, CAST(count(*) FILTER (verdict='flagged') AS BIGINT) AS flagged, CAST(count(*) FILTER (verdict='passed') AS BIGINT) AS passed, count(*) AS tested, round(100.0*count(*) FILTER (verdict<>'passed')/count(*), 6)::DOUBLE AS rate FROM z GROUP BY source")
def q64_evaluation_pivot(spark, sf):
    own = screening.screen(two_channels(spark, sf)).select("doc_id", "verdict").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return corpus.evaluation(own, "source").select("source", "blocked", "flagged", "passed", "tested", F.round("detection_rate", 6).alias("rate"))


TOPIC_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(x), {quoted('|'.join(words))}) THEN '{name}'" for name, words in P.TOPICS) + " ELSE 'general' END"
TOPIC_TEXT = "CASE doc_id % 6 WHEN 0 THEN 'A Stack is a list' WHEN 1 THEN 'Exam plan' WHEN 2 THEN 'Python' WHEN 3 THEN 'HMAC' WHEN 4 THEN 'Water' ELSE text END"


@query(f"SELECT topic, count(*) AS n, min(id) AS least FROM (SELECT 'doc_'||doc_id AS id, {TOPIC_SQL} AS topic FROM (SELECT doc_id, {TOPIC_TEXT} AS x FROM documents)) GROUP BY topic")
def q65_knowledge_topics(spark, sf):
    base = corpus.knowledge_base(table(spark, sf, "documents").select(F.col("doc_id").alias("index"), F.expr(TOPIC_TEXT).alias("text")))
    return base.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))


@query("SELECT q, md5(string_agg(md5(d.text), '|' ORDER BY rank)) AS texts FROM (SELECT a.vec_id AS q, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),4) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id<>b.vec_id WHERE a.vec_id % 20 = 0) JOIN documents d ON d.doc_id = vec_id WHERE rank<=5 GROUP BY q")
def q66_retrieved_texts(spark, sf):
    e = table(spark, sf, "embeddings")
    found = R.nearest(e, e.where("vec_id % 20 = 0")).select("q", F.concat(F.lit("doc_"), F.col("vec_id").cast("string")).alias("id"), "rank")
    base = table(spark, sf, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), "text")
    return corpus.retrieved(base, found).select("q", F.md5(F.array_join(F.transform("texts", F.md5), "|")).alias("texts"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S')||'_layer0_'||substr('request-'||event_id, 1, 8)||'_'||coalesce(nullif(replace(trim(regexp_replace(substr(event_type||' / no. '||user_id, 1, 30), '[^A-Za-z0-9 _-]', '_', 'g')), ' ', '_'), ''), 'output')||'.json' AS name FROM events")
def q67_output_names(spark, sf):
    text = F.concat("event_type", F.lit(" / no. "), F.col("user_id").cast("string"))
    return table(spark, sf, "events").select("event_id", outputs.output_name(F.col("ts"), F.lit("layer0"), F.concat(F.lit("request-"), F.col("event_id").cast("string")), text).alias("name"))


def listing(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("processing_type"), F.concat(F.lit("/out/"), F.col("event_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("modificationTime"))


@query("SELECT coalesce(event_type, 'total') AS processing_type, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def q68_output_stats(spark, sf):
    return outputs.output_stats(listing(spark, sf))


@query("SELECT '/out/'||event_id AS path FROM events WHERE event_type = 'click' ORDER BY ts DESC, '/out/'||event_id LIMIT 10")
def q69_recent_of_type(spark, sf):
    return outputs.recent(listing(spark, sf), "click").select("path")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def q70_expired_outputs(spark, sf):
    files = listing(spark, sf)
    now = files.agg(F.max("modificationTime").alias("now"))
    return outputs.expired(files.crossJoin(F.broadcast(now)), F.col("now")).agg(F.count(F.lit(1)).alias("n"))


NAMES = "CASE page_id % 7 WHEN 0 THEN 'A.TXT' WHEN 1 THEN 'b.md' WHEN 2 THEN 'c.PDF' WHEN 3 THEN 'd.jpeg' WHEN 4 THEN 'e.exe' WHEN 5 THEN 'noext' ELSE 'x.tar.docx' END"


@query(f"SELECT page_id, page_id % 7 IN (0,1,2,6) AS is_text, page_id % 7 = 3 AS is_image, page_id % 7 NOT IN (4,5) AS allowed, CASE WHEN length(html) > 5000 THEN 'file too large' WHEN page_id % 7 IN (4,5) THEN 'unsupported type' ELSE 'ok' END AS error, '/data/'||{NAMES} AS path FROM pages")
def q71_file_limits(spark, sf):
    name, size = F.expr(NAMES), F.length("html")
    return table(spark, sf, "pages").select("page_id", outputs.is_text_file(name).alias("is_text"), outputs.is_image_file(name).alias("is_image"), outputs.is_allowed(name).alias("allowed"), F.coalesce(outputs.file_error(name, size, 5000), F.lit("ok")).alias("error"), outputs.file_path("/data/", name).alias("path"))


EMOJI = "CASE doc_id % 4 WHEN 0 THEN text || '\U0001f600\U0001f680\U0001f600' WHEN 1 THEN '☀ ' || text WHEN 2 THEN 'a\tb  c' || chr(10) || chr(10) || chr(10) || 'd\u0007' ELSE text END"


@query(
    f"""WITH e AS (SELECT doc_id, {EMOJI} AS t FROM documents), n AS (SELECT doc_id, t, CASE doc_id % 4 WHEN 0 THEN '\U0001f600|\U0001f680' WHEN 1 THEN '☀' ELSE '' END AS found, CASE doc_id % 4 WHEN 0 THEN ':grinning_face:|:rocket:' WHEN 1 THEN ':black_sun_with_rays:' ELSE '' END AS names FROM e)
SELECT doc_id, found, names, CAST(length(t) AS BIGINT) AS before, CAST(length({NORMAL("replace(t, chr(7), '')")}) AS BIGINT) AS after, md5(replace(replace(replace({NORMAL("replace(t, chr(7), '')")}, '\U0001f600', ':grinning_face:'), '\U0001f680', ':rocket:'), '☀', ':black_sun_with_rays:')) AS demojized FROM n"""
)
def q72_normalize_with_emojis(spark, sf):
    own = table(spark, sf, "documents").withColumn("t", F.expr(EMOJI))
    r = T.normalized_with_source(F.col("t"), F.lit("user"))
    own = own.withColumn("r", r).withColumn("d", T.normalized(F.col("t"), keep_emojis=False)["normalized"])
    join = lambda c: F.array_join(c, "|")
    return own.select("doc_id", join("r.emojis").alias("found"), join("r.emoji_descriptions").alias("names"), F.col("r.original_length").cast("long").alias("before"), F.col("r.normalized_length").cast("long").alias("after"), F.md5("d").alias("demojized"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS n, string_agg('text_'||(turn), ',' ORDER BY turn) AS sources FROM conversations GROUP BY conv_id")
def q73_batch_sources(spark, sf):
    own = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    return own.select("conv_id", F.size("texts").cast("long").alias("n"), F.array_join(T.sources_of(F.col("texts")), ",").alias("sources"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def q74_embedding_similarity(spark, sf):
    e = table(spark, sf, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query()
def q75_embedding_hash(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", T.embedding_hash(F.col("embedding")).alias("hash"))


@query("SELECT user_id AS request_id, count(*) AS images_processed, bool_or(value > 95 OR event_type = 'error') AS suspicious, bool_or(value / 100 > 0.6) AS stego_detected, round(max(value / 100), 6) AS stego_score FROM events GROUP BY user_id")
def q76_image_output(spark, sf):
    v = F.col("value")
    own = table(spark, sf, "events").select(F.col("user_id").alias("request_id"), (v / 100).alias("stego_score"), (v / 100 > 0.6).alias("steganography"), (v > 95).alias("suspicious_entropy"), (F.col("event_type") == "error").alias("suspicious_metadata"), F.lit(None).cast("string").alias("exif_text"))
    # In this table hidden bits alone do not count as suspicious, so that the roll-up's flags are told apart.
    out = media.image_output(own.withColumn("steganography", F.lit(False))).select("request_id", "images_processed", "suspicious")
    seen = media.image_output(own).select("request_id", "stego_detected", F.round("stego_score", 6).alias("stego_score"))
    return out.join(seen, "request_id")


RUN = "CASE doc_id % 4 WHEN 0 THEN [] WHEN 1 THEN [0.2] WHEN 2 THEN [0.7, 0.1] ELSE [0.5] END"


@query(WITH + f", r AS (SELECT *, block IS NOT NULL AS rejected, coalesce(list_max({RUN}), 0.0)::DOUBLE AS stego FROM z) SELECT doc_id, CASE WHEN rejected THEN 'rejected' ELSE 'clean' END AS status, CASE WHEN rejected THEN 'skipped' ELSE 'clean' END AS prep, CASE WHEN rejected OR doc_id % 4 = 0 THEN 'skipped' ELSE 'clean' END AS image, CASE WHEN rejected THEN 0.0 ELSE stego END AS image_score, NOT rejected AND stego > 0.5 AS stego_detected, CASE WHEN rejected THEN 'none' ELSE {hmac_sql(quoted('chunk'))} END AS hmac FROM r")
def q77_staged_run(spark, sf):
    scores = F.expr("CASE doc_id % 4 WHEN 0 THEN array() WHEN 1 THEN array(0.2D) WHEN 2 THEN array(0.7D, 0.1D) ELSE array(0.5D) END").cast("array<double>")
    own = seeded(spark, sf).select("doc_id", F.col("t").alias("text"), F.array(F.lit("chunk")).alias("external_chunks"), scores.alias("image_scores"))
    done = orchestrate.Stages().run(own, KEY)
    return done.select("doc_id", "status", F.col("input_prep_status").alias("prep"), F.col("image_status").alias("image"), "image_score", "stego_detected", F.coalesce(F.col("hmacs")[0], F.lit("none")).alias("hmac"))


@query(f"SELECT CAST({len(P.BLOCK)} AS BIGINT) AS block, CAST({len(P.FLAG)} AS BIGINT) AS flag, CAST({len(P.BLOCK) + len(P.FLAG)} AS BIGINT) AS total")
def q78_rule_counts(spark, sf):
    return spark.createDataFrame([screening.RuleSet().counts()], "block long, flag long, total long")


@query(V + HEUR + ", " + RUNS + f", l AS (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN {like('substr(t, 1, 10000)', p, True)} THEN {quoted(p)} END" for p in P.DELIMITERS) + "], lambda x: x IS NOT NULL) AS ds, list_filter([" + ", ".join(f"CASE WHEN {like('substr(t, 1, 10000)', p, True)} THEN {quoted(p)} END" for p in P.KEYWORDS) + "], lambda x: x IS NOT NULL) AS ks FROM v) SELECT doc_id, md5(array_to_string(list_filter(list_concat([CASE WHEN f1 THEN 'long_base64' END], ds, [CASE WHEN coalesce(m.n,0)>=20 THEN 'repeated_chars' END, CASE WHEN f4 THEN 'long_single_line' END, CASE WHEN f5 THEN 'xml_tags' END, CASE WHEN f6 THEN 'html_comments' END], ks, [CASE WHEN f8 THEN 'many_delimiters' END]), lambda x: x IS NOT NULL), '|')) AS patterns FROM h JOIN l USING(doc_id) LEFT JOIN m USING(doc_id)")
def q79_detected_patterns(spark, sf):
    own = S.with_heuristics(table(spark, sf, "documents").withColumn("t", F.expr(SEED)), "t")
    return own.select("doc_id", F.md5(F.array_join("detected_patterns", "|")).alias("patterns"))


@query(f"WITH p AS (SELECT doc_id, {NORMAL('text')} AS u FROM documents) SELECT doc_id, CAST(length(u) + length(coalesce(lang, '')) AS BIGINT) AS char_total, CAST({TOKENS(chr(40) + 'u||coalesce(lang, ' + quoted('') + ')' + chr(41))} AS BIGINT) AS token_count, true AS hmac_verified FROM p JOIN documents USING(doc_id) WHERE {TRIM.format('text')} <> ''")
def q80_prepare_layer0(spark, sf):
    own = table(spark, sf, "documents").select("doc_id", F.col("text").alias("user_prompt"), F.array("lang").alias("external")).where(T.strip(F.col("user_prompt")) != "")
    return prepare.prepare_layer0(own, KEY).select("doc_id", F.col("char_total").cast("long").alias("char_total"), F.col("token_count").cast("long").alias("token_count"), "hmac_verified")
