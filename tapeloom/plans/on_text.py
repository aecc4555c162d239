"""Text, signal packs and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import text as tx
from tapeloom.operators import vector_index as vx
from tapeloom.operators import vectors as vc
from tapeloom.plans.registry import NUDGE, Query

QUERIES: list[Query] = []


def q(key, plan, out, sql=None):
    QUERIES.append(Query(key, plan, out, sql))


def qid():
    return F.col("quote_id")


# The prose of the documents is invented, so the compared query uses frequent tokens as its lexicon; the finance
# lexicon is tested on literal sentences.
LEX = {"the": 1.2, "ation": -0.7, "en the": 2.0, "que": 0.6, "der": -1.1, "ing of": 0.9, "une": 1.5, "zzz": 3.0, "para": -0.4}
NEG, INT, DIM, FWD, BWD = ("no", "de", "not"), {"of": 1.2, "und": 1.1}, {"and": 0.9, "la": 0.85}, ("with", "est"), ("was", "des", "ist")
vals = lambda xs: ", ".join(f"('{a}', {b})" for a, b in xs)
lst = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
FACT = {**DIM, **INT}
TOK = "regexp_split_to_array(regexp_replace(low, '^\\s+|\\s+$', '', 'g'), '\\s+')"


def lexicon_sql(source, terms, negations, factors, forward, backward):
    return f"""WITH d AS (SELECT doc_id, low, {TOK} AS tok FROM (SELECT doc_id, lower(text) AS low FROM ({source}) t) a),
lex AS (SELECT * FROM (VALUES {vals((k, float(v)) for k, v in terms.items())}) v(term, weight)),
h AS (SELECT d.doc_id, tok, weight, greatest(coalesce(list_position(tok, split_part(term, ' ', 1)), 0), 1) AS at_ FROM d JOIN lex ON contains(d.low, lex.term)),
n AS (SELECT doc_id, weight, list_distinct(tok[greatest(at_ - 3, 1):at_ + 3]) AS near FROM h),
f AS (SELECT doc_id, CASE WHEN list_has_any(near, {lst(negations)}) THEN CASE WHEN weight > 0 THEN -abs(weight) * 0.8 ELSE abs(weight) * 0.8 END ELSE weight END
   * {' * '.join(f"CASE WHEN list_contains(near, '{k}') THEN {v} ELSE 1 END" for k, v in factors.items())} AS w FROM n),
s AS (SELECT doc_id, sum(w) AS s, count(*) AS m FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(s, 0) * CASE WHEN list_has_any(tok, {lst(forward)}) THEN 1.08 ELSE 1 END * CASE WHEN list_has_any(tok, {lst(backward)}) THEN 0.96 ELSE 1 END AS lex_score, coalesce(m, 0) AS lex_matches
FROM d LEFT JOIN s ON d.doc_id = s.doc_id"""


scored = lambda t: tx.lexicon_score(t.texts(), "text", LEX, NEG, INT, DIM, FWD, BWD)
q("t01_lexicon_score", scored, "doc_id:l lex_score:5 lex_matches:l", lexicon_sql("SELECT doc_id, text FROM texts", LEX, NEG, FACT, FWD, BWD))
FINANCE = {**tx.BULLISH, **tx.BEARISH, **tx.REGIME}
QUALIFIERS = ("not", "never", *tx.INTENSIFIERS, *tx.DIMINISHERS, *tx.FORWARD, *tx.BACKWARD, "the", "a")


def finance_texts(t):
    """Every text behind a line of two finance terms and a qualifier, which its id chooses: the invented prose holds few of the terms."""
    one = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    i = F.col("doc_id")
    return t.texts().withColumn("text", F.concat_ws(" ", one(QUALIFIERS, i), one(FINANCE, i), F.lit("on"), one(FINANCE, i * 7 + 3), "text"))


pick = lambda xs, k: f"({lst(xs)})[CAST(({k}) % {len(xs)} + 1 AS INT)]"
q("t01_finance_lexicon", lambda t: tx.lexicon_score(finance_texts(t)), "doc_id:l lex_score:5 lex_matches:l", lexicon_sql(
    f"SELECT doc_id, concat_ws(' ', {pick(QUALIFIERS, 'doc_id')}, {pick(FINANCE, 'doc_id')}, 'on', {pick(FINANCE, 'doc_id * 7 + 3')}, text) AS text FROM texts",
    FINANCE, tx.NEGATIONS, {**tx.DIMINISHERS, **tx.INTENSIFIERS}, tx.FORWARD, tx.BACKWARD))
PW, NW = ("the", "que", "ing"), ("der", "des", "was", "no")
cnt = lambda col, ws: " + ".join(f"CASE WHEN contains({col}, '{w}') THEN 1 ELSE 0 END" for w in ws)
POL = f"SELECT doc_id, symbol, coalesce((({cnt('low', PW)}) - ({cnt('low', NW)})) / nullif(({cnt('low', PW)}) + ({cnt('low', NW)}), 0), 0) AS p FROM (SELECT doc_id, symbol, lower(text) AS low FROM texts) a"
q("t02_keyword_polarity", lambda t: t.texts().withColumn("low", F.lower("text")).withColumn("polarity", tx.keyword_polarity(F.col("low"), PW, NW)), "doc_id:l polarity:6", f"SELECT doc_id, p AS polarity FROM ({POL}) x")
q("a12_news_sentiment", lambda t: tx.news_sentiment(t.texts(), "text", PW, NW), "symbol sentiment_score:6 confidence:6 sample_size:l",
  f"SELECT symbol, avg(p) AS sentiment_score, least(0.8, greatest(0.2, avg(abs(p)))) AS confidence, count(*) AS sample_size FROM ({POL}) x GROUP BY symbol")


def model_rows(t):
    """Model scores arrive as columns; here they are derived from the readings."""
    e = F.col("event_id")
    z = lambda c, m: F.when(e % m == 0, 0.0).otherwise(c)
    return t.sentiments().select(
        "event_id", z(F.col("score"), 5).alias("vader"), z((e * 17 % 200) / 100.0 - 1, 10).alias("finbert"), F.col("confidence").alias("finbert_conf"),
        z((e * 7 % 90) / 10.0 - 4.5, 5).alias("lex_score"), F.when(e % 5 == 0, 0).otherwise(e % 9).alias("lex_matches"), (e % 300).alias("length"), F.when(e % 4 == 0, (e % 21) / 10.0 - 1).alias("blob"))


MODEL = """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0e0 ELSE score END AS v, CASE WHEN event_id % 10 = 0 THEN 0e0 ELSE (event_id * 17 % 200) / 100e0 - 1 END AS f, confidence AS fc,
 CASE WHEN event_id % 5 = 0 THEN 0e0 ELSE (event_id * 7 % 90) / 10e0 - 4.5e0 END AS ls, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 9 END AS m, event_id % 300 AS n, CASE WHEN event_id % 4 = 0 THEN (event_id % 21) / 10e0 - 1 END AS b FROM sentiments"""
WTS = f"""SELECT *, tanh(ls / 3) AS l, wv / (wv + wl + wf) AS pv, wl / (wv + wl + wf) AS pl, wf / (wv + wl + wf) AS pf FROM (SELECT *, 0.3e0 * CASE WHEN n > 200 THEN 0.8 ELSE 1 END AS wv,
 0.2e0 * CASE WHEN n < 50 THEN 1.5 ELSE 1 END * CASE WHEN m > 3 THEN 1.4 ELSE 1 END AS wl,
 0.5e0 * CASE WHEN n < 50 THEN 0.7 WHEN n > 200 THEN 1.3 ELSE 1 END * CASE WHEN fc > 0.8 THEN 1.2 WHEN fc < 0.5 THEN 0.6 ELSE 1 END AS wf FROM ({MODEL}) a) b"""
ENS = f"""SELECT *, CASE WHEN abs(v) < 1e-6 AND abs(l) < 1e-6 AND abs(f) < 1e-6 THEN coalesce(b, 0) WHEN b IS NULL THEN v * pv + l * pl + f * pf ELSE (v * pv + l * pl + f * pf + b) / 2 END AS e,
 CASE WHEN abs(v) >= abs(l) AND abs(v) >= abs(f) THEN v WHEN abs(l) >= abs(f) THEN l ELSE f END AS best, sqrt(((v - (v + l + f) / 3) ** 2 + (l - (v + l + f) / 3) ** 2 + (f - (v + l + f) / 3) ** 2) / 3) AS sd FROM ({WTS}) c"""
q("t03_ensemble_score", lambda t: tx.ensemble_score(model_rows(t)), "event_id:l ensemble_score:6 confidence:6", f"""
SELECT event_id, CASE WHEN abs(e) < 1e-6 AND best <> 0 THEN best ELSE e END AS ensemble_score,
 greatest(0, least(1, abs(v) * 0.3 + least(1, m / 5e0) * 0.2 + fc * 0.4 + least(1, n / 100e0) * 0.1) - least(0.15, sd * 0.2)) AS confidence FROM ({ENS}) d""")
q("t04_batch_ensemble", lambda t: tx.batch_ensemble(model_rows(t)), "event_id:l ensemble_score:6 confidence:6", f"""
SELECT event_id, v * pv + f * pf + CASE WHEN m > 0 THEN ls ELSE 0 END * pl AS ensemble_score, greatest(0.05, least(0.99, abs(f) * 0.5 + abs(v) * 0.3 + least(1, m / 8e0) * 0.2)) AS confidence FROM ({WTS}) c""")
EW, DW = ("theth", "ation"), ("une", "ingen")
has = lambda ws: " OR ".join(f"contains(low, '{w}')" for w in ws)
q("t05_context_boost", lambda t: t.texts().withColumn("low", F.lower("text")).withColumn("boosted", tx.context_boost(F.col("low"), F.col("doc_id") % 21 / 10.0 - 1, EW, DW)), "doc_id:l boosted:6", f"""
SELECT doc_id, least(1, greatest(-1, (doc_id % 21 / 10e0 - 1) * CASE WHEN {has(EW)} THEN 1.15 ELSE 1 END * CASE WHEN {has(DW)} THEN 1.1 ELSE 1 END)) AS boosted FROM (SELECT doc_id, lower(text) AS low FROM texts) a""")

# Vectors ---------------------------------------------------------------------------------------------------------
vecs = lambda t: t.raw("embeddings").select("vec_id", "embedding")
qvecs = lambda t: t.raw("embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
DIST = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2))"
HITS = f"""SELECT query_id, vec_id, 1 - d AS score, rank_ AS rank_ FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS rank_ FROM (
 SELECT a.vec_id AS query_id, b.vec_id, {DIST} AS d FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) x) y WHERE rank_ <= 5"""
q("t07_similar_vectors", lambda t: vc.similar(qvecs(t), vecs(t), 5).withColumnRenamed("rank", "rank_"), "query_id:l vec_id:l score:5 rank_:l", HITS)
NRM = lambda x: f"sqrt(list_sum(list_transform({x}.embedding, lambda z: CAST(z AS DOUBLE) ** 2)))"
q("t07_similar_cosine", lambda t: vc.similar(qvecs(t), vecs(t), 3, "cosine").withColumnRenamed("rank", "rank_"), "query_id:l vec_id:l score:6 rank_:l", f"""
SELECT query_id, vec_id, s AS score, rank_ FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - s, 9), vec_id) AS rank_ FROM (SELECT a.vec_id AS query_id, b.vec_id,
 list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / ({NRM('a')} * {NRM('b')}) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) x) y WHERE rank_ <= 3""")


def indexed(t, metric, k):
    """A query's k neighbours by the index, and for all queries: is recall 0.9 or more, were under a tenth of the vectors read, are the scores exact?"""
    v, qs = vecs(t), qvecs(t)
    ix = vx.fit(v, metric=metric)
    hits, exact = vx.search(qs, vx.assign(v, ix), ix, k), vc.similar(qs, v, k, metric)
    enough = vx.recall(hits, exact).select(F.col("recall") >= 0.9).scalar()
    own = v.select("vec_id", F.col("embedding").alias("e")).join(hits, "vec_id").join(qs, "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda x, y: x + y)
    off = dot("e", "e") + dot("embedding", "embedding") - 2 * dot("e", "embedding") if metric == "l2" else 1 - dot("e", "embedding") / F.sqrt(dot("e", "e") * dot("embedding", "embedding"))
    g = own.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.max(F.abs(1 - F.col("score") - off) < 1e-6).alias("scores_exact"))
    few = v.agg(F.count(F.lit(1)) * 0.1 > k * 8).scalar()
    return g.withColumns({"enough": enough, "few_read": few})


for metric, k in (("l2", 5), ("cosine", 5)):
    q(f"t07_indexed_{metric}", lambda t, metric=metric, k=k: indexed(t, metric, k), "query_id:l hits:l scores_exact:b enough:b few_read:b",
      f"SELECT vec_id AS query_id, {k} AS hits, true AS scores_exact, true AS enough, true AS few_read FROM embeddings WHERE vec_id % 50 = 0")


def trade_rows(t):
    return t.quotes().select(
        F.col("symbol").alias("ticker"), F.col("source").alias("direction"), F.date_format("ts", "yyyy-MM").alias("date"), F.when(qid() % 9 != 0, F.concat(F.lit("thesis "), qid().cast("string"))).alias("thesis"),
        F.lit("tree").alias("scenario_tree"), F.when(qid() % 14 != 0, "none").alias("counter_signal"), qid().alias("ingest"))


q("t08_upsert_vectors", lambda t: vc.upsert_vectors(trade_rows(t)), "id ticker direction date thesis ingest:l", """
SELECT sha256(concat(symbol, '-', strftime(ts, '%Y-%m'), '-', source)) AS id, symbol AS ticker, source AS direction, strftime(ts, '%Y-%m') AS date, concat('thesis ', CAST(quote_id AS VARCHAR)) AS thesis, quote_id AS ingest
FROM (SELECT *, row_number() OVER (PARTITION BY symbol, strftime(ts, '%Y-%m'), source ORDER BY quote_id DESC) AS rn FROM quotes WHERE quote_id % 9 <> 0 AND quote_id % 14 <> 0) x WHERE rn = 1""")
q("t09_collection_stats", lambda t: vc.collection_stats(t.raw("embeddings"), ("label",)), "label:l total_vectors:l dimensions:l", "SELECT label, count(*) AS total_vectors, min(len(embedding)) AS dimensions FROM embeddings GROUP BY label")


def boosted(t):
    pay = t.raw("embeddings").select("vec_id", F.concat(F.lit("T"), F.col("vec_id").cast("string")).alias("ticker"), F.lit("long").alias("direction"), F.col("label").cast("string").alias("thesis"), F.lit(None).cast("string").alias("date"))
    base = t.raw("embeddings").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("base "), F.col("vec_id").cast("string")).alias("base"))
    return vc.attach_similar(base, vc.similar(qvecs(t), vecs(t), 5), pay)


q("j15_attach_similar", boosted, "query_id:l boosted", f"""
SELECT e.vec_id AS query_id, CASE WHEN l IS NULL THEN concat('base ', CAST(e.vec_id AS VARCHAR)) ELSE concat('base ', CAST(e.vec_id AS VARCHAR), chr(10), chr(10), '### SIMILAR PAST SCENARIOS:', chr(10), l) END AS boosted
FROM embeddings e LEFT JOIN (SELECT query_id, string_agg(concat('- Ticker: T', CAST(h.vec_id AS VARCHAR), ', Direction: long, Thesis: ', CAST(label AS VARCHAR), ', Date: N/A'), chr(10) ORDER BY rank_) AS l
 FROM ({HITS}) h JOIN embeddings v ON h.vec_id = v.vec_id GROUP BY query_id) g ON e.vec_id = g.query_id""")

# Scalar families -------------------------------------------------------------------------------------------------
CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '[^\\x20-\\x7E]', '', 'g'), '\\s+', ' ', 'g'))"
q("x01_string_features", lambda t: tx.string_features(t.raw("conversations"), "text"), "conv_id:l turn:l text_clean text_length:l text_word_count:l", """
SELECT conv_id, turn, regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '[^\\p{L}\\p{N}_\\s]', '', 'g') AS text_clean, length(text) AS text_length,
 CASE WHEN regexp_replace(text, '\\s+', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) END AS text_word_count FROM conversations""")
q("x02_clean_text", lambda t: t.raw("conversations").withColumn("cleaned", tx.clean_text(F.col("text"), 120)), "conv_id:l turn:l cleaned",
  f"SELECT conv_id, turn, CASE WHEN length(c) > 120 THEN concat(substr(c, 1, 120), '...') ELSE c END AS cleaned FROM (SELECT conv_id, turn, {CLEAN.format(x='text')} AS c FROM conversations) a")
q("x03_clean_post", lambda t: t.raw("documents").withColumn("post", tx.clean_post(F.concat(F.col("text"), F.lit(" via @"), F.col("source"), F.lit(" https://x.example/"), F.col("source"), F.lit("?q=1  now\n ok")))), "doc_id:l post", """
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(concat_ws('', text || ' via @' || source || ' https://x.example/' || source || '?q=1  now' || chr(10) || ' ok'), 'https?://[^\\s]+', '', 'g'), '@\\w+', '', 'g'), '\\s+', ' ', 'g')) AS post FROM documents""")
q("x04_cashtags", lambda t: heads(t).withColumn("tags", F.array_join(F.array_sort(tx.cashtags(F.col("body"))), "|")), "doc_id:l tags", """
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(body), '\\$([A-Z]{1,5})', 1))), '|') AS tags FROM (SELECT doc_id, concat('$aa', chr(CAST(97 + doc_id % 26 AS INT)), ' vs $AAB $toolongtag ', text) AS body FROM documents) a""")
heads = lambda t: t.raw("documents").withColumn("body", F.concat(F.lit("$aa"), F.char((97 + F.col("doc_id") % 26).cast("int")), F.lit(" vs $AAB $toolongtag "), F.col("text")))
EXP = "replace(replace(body, '$', ''), '%', ' percent ')"
for a_, b_ in tx.ABBREVIATIONS:
    EXP = f"replace({EXP}, '{a_}', '{b_}')"
q("x05_expand_finance", lambda t: t.raw("conversations").withColumn("expanded", tx.expand_finance(F.concat(F.lit("CEO said EPS up 5% to $2, P/E and M&A in Q3: "), "text"))), "conv_id:l turn:l expanded",
  f"SELECT conv_id, turn, {EXP} AS expanded FROM (SELECT conv_id, turn, concat('CEO said EPS up 5% to $2, P/E and M&A in Q3: ', text) AS body FROM conversations) a")
q("x06_money", lambda t: t.quotes().select("quote_id", tx.percent_change(qid() % 7, qid() % 11).alias("change"), F.round(F.col("price") * 1e8 / 1e9, 2).alias("cap_billions"), tx.currency_text(qid() * qid() * 0.753 + 0.0012345).alias("amount")), "quote_id:l change:4 cap_billions:2 amount", """
SELECT quote_id, CASE WHEN quote_id % 7 = 0 THEN 0 ELSE (quote_id % 11 - quote_id % 7) / (quote_id % 7) * 100 END AS change, round(price * 1e8 / 1e9, 2) AS cap_billions,
 CASE WHEN a >= 1e9 THEN printf('$%.2fB USD', a / 1e9) WHEN a >= 1e6 THEN printf('$%.2fM USD', a / 1e6) WHEN a >= 1e3 THEN printf('$%.2fK USD', a / 1e3) ELSE printf('$%.2f USD', a) END AS amount FROM (SELECT *, quote_id * quote_id * 0.753e0 + 0.0012345e0 AS a FROM quotes) x""")
NW_ = "CASE WHEN regexp_replace(text, '\\s+', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) END"
q("x07_token_estimate", lambda t: t.texts().withColumn("tokens", tx.token_estimate(F.col("text"))).withColumn("by_length", F.floor(F.length("text") / 4)), "doc_id:l tokens:l by_length:l", f"SELECT doc_id, floor({NW_} * 1.3e0) AS tokens, length(text) // 4 AS by_length FROM texts")
q("x08_compress", lambda t: t.raw("conversations").withColumn("short", tx.compress_words(F.col("text"), 6)), "conv_id:l turn:l short",
  f"SELECT conv_id, turn, CASE WHEN {NW_} > 6 THEN concat(array_to_string(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')[1:6], ' '), '...') ELSE text END AS short FROM conversations")
q("x08_compress_map", lambda t: t.raw("conversations").withColumn("m", tx.compress_map(F.create_map(F.lit("a"), F.col("text"), F.lit("b"), F.col("role"), F.lit("c"), F.lit("x"), F.lit("d"), F.lit("y")), 3, 20)).withColumn("short", F.concat_ws("|", F.map_keys("m"), F.map_values("m"))), "conv_id:l turn:l short",
  "SELECT conv_id, turn, concat_ws('|', 'a', 'b', 'c', CASE WHEN length(text) > 20 THEN concat(substr(text, 1, 20), '...') ELSE text END, role, 'x') AS short FROM conversations")
q("x09_date_parts", lambda t: tx.date_parts(t.bars()), "symbol ts day_of_week:l is_monday:l is_friday:l month:l is_month_end:l is_quarter_end:l", """
SELECT symbol, ts, isodow(ts) - 1 AS day_of_week, CASE WHEN isodow(ts) = 1 THEN 1 ELSE 0 END AS is_monday, CASE WHEN isodow(ts) = 5 THEN 1 ELSE 0 END AS is_friday, month(ts) AS month, CASE WHEN day(ts) > 25 THEN 1 ELSE 0 END AS is_month_end,
 coalesce(quarter(ts) - lag(quarter(ts)) OVER (PARTITION BY symbol ORDER BY ts), 0) AS is_quarter_end FROM bars""")
q("x09_expiry_marks", lambda t: tx.expiry_marks(t.chain()), "contract_id:l is_expiry_week:l is_expiry_month:l", "SELECT contract_id, CASE WHEN dte <= 5 THEN 1 ELSE 0 END AS is_expiry_week, CASE WHEN dte <= 30 THEN 1 ELSE 0 END AS is_expiry_month FROM chain")
q("x16_daily_open_close", lambda t: tx.daily_open_close(t.bars().withColumns({c: F.floor(F.col(c) * 1e4 + NUDGE) / 1e4 for c in ("open", "close")}), "1997-03-01", "1997-04-15"), "symbol line", """
SELECT symbol, string_agg(concat(strftime(ts, '%Y-%m-%d'), ' o:', printf('%.4f', floor(open * 1e4 + 0.49997) / 1e4), ', c:', printf('%.4f', floor(close * 1e4 + 0.49997) / 1e4)), ' ' ORDER BY ts) AS line FROM bars WHERE ts BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-04-15' GROUP BY symbol""")


def messy(t):
    """Model answers in six shapes that carry the same three-case tree, and a seventh without one."""
    k = qid()
    n = k.cast("string")
    tree = F.concat(F.lit('{"base_case": "'), n, F.lit('% flat", "bull_case": "up", "bear_case": "down"}'))
    with_key = F.concat(F.lit('"scenario_tree": '), tree)
    return t.quotes().withColumn("answer", F.when(k % 7 == 0, F.concat(F.lit("{"), with_key, F.lit("}"))).when(k % 7 == 1, F.concat(F.lit('{"trades": [{"ticker": "A"}, {'), with_key, F.lit(",}]}")))
        .when(k % 7 == 2, F.concat(F.lit("Sure:\n```json\n{"), with_key, F.lit("}\n```\ndone"))).when(k % 7 == 3, F.concat(F.lit("The plan "), with_key, F.lit(" as asked")))
        .when(k % 7 == 4, F.translate(F.concat(F.lit("Cases: "), tree), '"', "'")).when(k % 7 == 5, F.concat(F.lit("```json\n{"), with_key, F.lit("} // note\n```"))).otherwise("no tree at all {1}"))


q("x17_repair_json", lambda t: messy(t).withColumn("fixed", tx.repair_json(F.concat(F.lit("```json\n{'a': 1, /* x\ny */ 'b': ["), qid().cast("string"), F.lit(", ],} // end\n```  ")))), "quote_id:l fixed",
  "SELECT quote_id, concat('{''a'': 1,  ''b'': [', CAST(quote_id AS VARCHAR), ']}') AS fixed FROM quotes")
q("x18_scenario_tree", lambda t: messy(t).withColumn("m", tx.scenario_tree(F.col("answer"))).select("quote_id", *[F.col("m")[c].alias(c) for c in ("base_case", "bull_case", "bear_case")]), "quote_id:l base_case bull_case bear_case", """
SELECT quote_id, CASE WHEN quote_id % 7 < 6 THEN concat(CAST(quote_id AS VARCHAR), '% flat') END AS base_case, CASE WHEN quote_id % 7 < 6 THEN 'up' END AS bull_case, CASE WHEN quote_id % 7 < 6 THEN 'down' END AS bear_case FROM quotes""")


def playbooks(t):
    k = qid()
    full = F.concat(F.lit('{"ticker": "'), F.col("symbol"), F.lit('", "direction": "long", "entry_range": "1-2", "profit_target": "3", "stop_loss": "1"}'))
    return t.quotes().withColumn("doc", F.when(k % 5 == 0, "{broken").when(k % 5 == 1, F.concat(F.lit('{"trades": ['), full, F.lit(", "), full, F.lit('], "tomorrows_tape": "calm"}'))).when(k % 5 == 2, '{"trades": [{"ticker": "A"}], "tomorrows_tape": "  "}')
        .when(k % 5 == 3, '{"trades": [], "tomorrows_tape": "calm"}').otherwise('{"tomorrows_tape": "calm"}'))


q("x19_playbook_quality", lambda t: tx.playbook_quality(playbooks(t), "doc"), "quote_id:l valid_json:b has_trades:b has_tape:b trades_complete:b trade_count:l completeness_score:5", """
SELECT quote_id, k <> 0 AS valid_json, k IN (1, 2, 3) AS has_trades, k IN (1, 3, 4) AS has_tape, k = 1 AS trades_complete, CASE k WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS trade_count,
 CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN (0.5 + 0.5) / 2 WHEN 3 THEN 0.375 ELSE 0.25 END AS completeness_score FROM (SELECT quote_id, quote_id % 5 AS k FROM quotes) x""")
q("x20_opaque_id", lambda t: t.quotes().withColumn("id", tx.opaque_id(F.col("symbol"), F.date_format("ts", "yyyy-MM-dd"), F.col("source"))), "quote_id:l id", "SELECT quote_id, sha256(concat(symbol, '-', strftime(ts, '%Y-%m-%d'), '-', source)) AS id FROM quotes")
q("x21_bands", lambda t: t.runs().withColumn("level", tx.confidence_level(F.col("accuracy"))).withColumn("band", tx.quality_band(F.col("accuracy") * 100)), "run_id:l level band", """
SELECT run_id, CASE WHEN accuracy >= 0.9 THEN 'very_high' WHEN accuracy >= 0.7 THEN 'high' WHEN accuracy >= 0.5 THEN 'medium' WHEN accuracy >= 0.3 THEN 'low' ELSE 'very_low' END AS level,
 CASE WHEN accuracy * 100 >= 95 THEN 'excellent' WHEN accuracy * 100 >= 80 THEN 'good' WHEN accuracy * 100 >= 60 THEN 'fair' WHEN accuracy * 100 >= 40 THEN 'poor' ELSE 'unusable' END AS band FROM runs""")

# Signal packs ----------------------------------------------------------------------------------------------------
UPW, DNW, WLD = ("the", "ent", "ing"), ("der", "une", "que"), ("ation", "sch", "para", "our")
q("g21_market_condition", lambda t: tx.market_condition(t.texts().select("doc_id", F.col("text").alias("sentiment_text"), F.col("source").alias("internals_text"), (F.col("doc_id") % 6).alias("n_earnings"), (F.col("doc_id") % 27).alias("n_flow")), UPW, DNW, WLD), "doc_id:l condition", f"""
SELECT doc_id, CASE WHEN doc_id % 6 > 3 THEN 'earnings' WHEN doc_id % 27 > 20 THEN 'options_heavy' WHEN w > 2 THEN 'volatile' WHEN u > d AND u > 1 THEN 'bullish' WHEN d > u AND d > 1 THEN 'bearish' ELSE 'sideways' END AS condition
FROM (SELECT doc_id, {cnt('low', UPW)} AS u, {cnt('low', DNW)} AS d, {cnt('both_', WLD)} AS w FROM (SELECT doc_id, lower(text) AS low, lower(concat(source, text)) AS both_ FROM texts) a) b""")
q("g22_clean_signal_pack", lambda t: tx.clean_signal_pack(t.raw("conversations").select("conv_id", "role", F.col("turn").alias("position"), F.col("text").alias("item")), ["conv_id", "role"], 3, 60).withColumnRenamed("rank", "rank_"), "conv_id:l role item rank_:l", f"""
SELECT conv_id, role, item, rank_ FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY p) AS rank_ FROM (SELECT conv_id, role, item, min(turn) AS p FROM (
 SELECT conv_id, role, turn, CASE WHEN length(c) > 60 THEN concat(substr(c, 1, 60), '...') ELSE c END AS item FROM (SELECT *, {CLEAN.format(x='text')} AS c FROM conversations) a) b WHERE item <> '' GROUP BY 1, 2, 3) d) e WHERE rank_ <= 3""")


def packs(t):
    i = F.col("run_id")
    return t.runs().select("model", F.lpad(i.cast("string"), 12, "0").alias("signal"), F.to_date("ts").alias("pack"), (i * 13 % 97 / 97.0).alias("weight"), (i % 3 == 0).alias("priority"), (i % 150 + 5).alias("words"))


q("k06_budgeted_pick", lambda t: tx.budgeted_pick(packs(t), 900, ["pack", "model"]).withColumn("picked", F.array_join(F.transform("picked", lambda x: F.concat_ws(":", x["signal"], x["words"].cast("string"))), "|")), "pack model used:l picked", """
WITH RECURSIVE o AS (SELECT *, CAST(floor(w * 1.3e0) AS BIGINT) AS tk, row_number() OVER (PARTITION BY pack, model ORDER BY -p, sig) AS i FROM (
 SELECT CAST(ts AS DATE) AS pack, model, lpad(CAST(run_id AS VARCHAR), 12, '0') AS sig, run_id % 150 + 5 AS w, (run_id * 13 % 97 / 97e0) * CASE WHEN run_id % 3 = 0 THEN 1 ELSE 0.5e0 END AS p FROM runs) r),
s AS (SELECT DISTINCT pack, model, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, '' AS picked FROM o
 UNION ALL SELECT pack, model, i, used + CASE WHEN kept IS NULL THEN 0 ELSE CAST(floor(kept * 1.3e0) AS BIGINT) END, CASE WHEN kept IS NULL THEN picked ELSE concat(picked, CASE WHEN picked = '' THEN '' ELSE '|' END, sig, ':', kept) END
 FROM (SELECT s.pack, s.model, s.i + 1 AS i, used, picked, sig, CASE WHEN used + tk <= 900 THEN w WHEN p > 0.5e0 AND used < 900 THEN least(w, 900 - used) END AS kept
  FROM s JOIN o ON s.pack = o.pack AND s.model = o.model AND o.i = s.i + 1) n)
SELECT pack, model, used, picked FROM (SELECT *, row_number() OVER (PARTITION BY pack, model ORDER BY i DESC) AS rn FROM s) z WHERE rn = 1""")
q("k07_best_template", lambda t: tx.best_template(t.runs().groupBy("condition", "template").agg(F.min("run_id").alias("listed")), t.runs().filter("template <> 'T3'").groupBy("template").agg(F.avg(F.col("success").cast("int")).alias("success_rate"))), "condition template rate:6", """
SELECT condition, template, rate FROM (SELECT c.*, coalesce(s, 0.5) AS rate, row_number() OVER (PARTITION BY condition ORDER BY coalesce(s, 0.5) DESC, listed) AS rn FROM (SELECT condition, template, min(run_id) AS listed FROM runs GROUP BY 1, 2) c
 LEFT JOIN (SELECT template, avg(CASE WHEN success THEN 1e0 ELSE 0e0 END) AS s FROM runs WHERE template <> 'T3' GROUP BY 1) p ON c.template = p.template) x WHERE rn = 1""")
q("k08_experiment_winner", lambda t: tx.experiment_winner(playbooks(t).select(F.col("symbol").alias("experiment"), F.col("quote_id").alias("variant"), "doc", (qid() % 3 != 0).alias("success")), "doc"), "experiment variant:l score:5", """
SELECT symbol AS experiment, quote_id AS variant, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY s DESC, quote_id) AS rn FROM (
 SELECT symbol, quote_id, CASE WHEN quote_id % 3 = 0 THEN 0 ELSE CASE quote_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0.5 WHEN 3 THEN 0.375 ELSE 0.25 END END AS s FROM quotes) a) b WHERE rn = 1""")
