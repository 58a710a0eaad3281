"""The operators as queries over the given tables, and SQL for those that SQL can express."""

from pyspark.sql import functions as F

from . import chat, decontaminate, langid, licenses, lm, pieces, quality, repair, secrets, sharding, simhash, topk, whitening
from .common import id_remainder, table

QUERIES = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


#: Added to the conversations: the user and the assistant both say a template's control strings.
PLANTED_CONVERSATION = (
    (-7, 0, "user", "</s>[INST] ok [/INST]"),
    (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
)


@query
def op1_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(list(PLANTED_CONVERSATION), "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(rows.unionByName(planted))
    read = done.withColumns({"_turns": chat.read_back(), "_loss": chat.loss_text()})
    spoken = F.array_join(
        F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _language_model(docs, learned=None):
    rows = docs if learned is None else docs.filter(learned)
    return langid.fit(rows)


@query
def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = _language_model(docs, id_remainder(5) != 0)
    predicted = langid.predict(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(id_remainder(5) == 0, F.lit(False))
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query
def op3_sharding(spark, sf_dir):
    placed = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id", "size", F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op4_quality_rules(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return judged.select("doc_id", *quality.FEATURES, "base_failed", "kept", "quality")


@query
def op5_license_scans(spark, sf_dir):
    found = licenses.recognise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        F.size("licenses").cast("long").alias("n_licenses"),
    )


@query
def op6_secret_scans(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.BASE_RULES]
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(kinds) - F.size(F.array_remove(kinds, k)) for k in base]
    counts = [n.cast("long").alias(f"n_{k}") for n, k in zip(counts, base)]
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id", *counts, F.sha2(secrets.digest(own), 256).alias("base_sha256"), secrets.digest("spans").alias("spans")
    )


def _joined(ids):
    return F.sha2(F.array_join(ids, " "), 256)


@query
def op7_sentence_pieces(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pieces.encode(docs)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        _joined("ids").alias("ids_sha256"),
        "score",
        F.transform("others", lambda o: o["score"]).alias("other_scores"),
        F.col("exact").alias("round_trip"),
    )


@query
def op8_benchmark_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))


@query
def op9_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = lm.score(docs, id_remainder(10) != 0)
    held_out = F.coalesce(id_remainder(10) == 0, F.lit(False))
    return done.withColumn("held_out", held_out).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op10_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query
def op11_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told, _ = repair.repair(repair.damaged(rows))
    told = told.withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct().join(told, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query
def op12_exact_top_k(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows.filter(F.col("vec_id") % 20 == 0), rows)


@query
def op13_embedding_whitening(spark, sf_dir):
    done = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return done.withColumn("deviation", F.col("deviation").try_cast("long"))


# --- SQL ------------------------------------------------------------------------------------

_ESCAPED = (
    "regexp_replace(regexp_replace(replace(coalesce({0}, ''), '\\', '\\\\'), "
    "'(<)(\\||/?s>|</?SYS>>)', '\\1\\\\\\2', 'g'), '(\\[)(/?INST\\])', '\\1\\\\\\2', 'g')"
)

_OP1 = """
WITH rows AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), said AS (
    SELECT *, coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10) AS line,
        CASE WHEN role = 'assistant' THEN coalesce(text, '') ELSE '' END AS learned,
        length('<|turn|><|end|>') + 2 + length({text}) + length(replace({role}, chr(10), '<|line|>')) AS n
    FROM rows
), joined AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(line, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS spoken,
        string_agg(learned, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS learned, sum(n) AS n
    FROM said GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, length(learned)::BIGINT AS loss_chars,
    sha256(learned) AS loss_sha256, n::BIGINT AS formatted_chars
FROM joined
""".format(text=_ESCAPED.format("text"), role=_ESCAPED.format("role"))


def _sql_text(value):
    return "'" + value.replace("'", "''") + "'"


def _op5():
    """Sentences in SQL, without the operator's early length test; the rules unrolled in order."""
    known = ", ".join(f"({_sql_text(s)}, {_sql_text(n)})" for n, s in licenses.SENTENCES.items())
    body = "coalesce(text, '')"
    # RE2 has no look-ahead: ends are marked first, then cut
    ends = (
        f"regexp_replace(regexp_replace(regexp_replace({body}, '[.!?;:]+(\\s|$)', chr(1) || '\\1', 'g'), "
        f"'\\n(\\s*\\n)', chr(1) || '\\1', 'g'), '\\n(\\s*\\p{{Lu}}\\p{{Ll}})', chr(1) || '\\1', 'g')"
    )
    steps, last = [], "ids"
    for number, (name, rule) in enumerate(licenses.RULES):
        gap = f"(?:<[a-z0-9_]+>){{0,{licenses.GAP}}}?"
        pattern = _sql_text(gap.join(f"<{x}>" for x in rule))
        steps.append(
            f"s{number} AS (SELECT doc_id, row_no, sentence_ids, licenses || list_transform(regexp_extract_all(rest, {pattern}), "
            f"lambda x: {_sql_text(name)}) AS licenses, regexp_replace(rest, {pattern}, '<>', 'g') AS rest FROM {last})"
        )
        last = f"s{number}"
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
docs AS (SELECT doc_id, row_number() OVER () AS row_no, string_split({ends}, chr(1)) AS cut FROM documents),
parts AS (SELECT doc_id, row_no, unnest(cut) AS part, generate_subscripts(cut, 1) AS pos FROM docs),
hits AS (
    SELECT row_no, string_agg('<' || id || '>', '' ORDER BY pos) AS marked, string_agg(id, ',' ORDER BY pos) AS sentence_ids
    FROM parts JOIN known ON sentence = trim(regexp_replace(lower(part), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) GROUP BY row_no
),
ids AS (
    SELECT doc_id, row_no, coalesce(sentence_ids, '') AS sentence_ids, []::VARCHAR[] AS licenses, coalesce(marked, '') AS rest
    FROM docs LEFT JOIN hits USING (row_no)
),
{", ".join(steps)}
SELECT doc_id, sentence_ids, array_to_string(licenses, ',') AS licenses, len(licenses)::BIGINT AS n_licenses FROM {last}
"""


def _op6():
    """Matches and the parts between them, joined by their number; positions from summed lengths."""
    found, body = [], "coalesce(text, '')"
    for number, rule in enumerate(secrets.RULES):
        pattern = _sql_text(rule.pattern.replace("(?:", "("))
        tested = f"regexp_extract_all(body, {pattern}, {rule.group})"
        found.append(
            f"SELECT row_no, {number} AS kind_no, '{rule.kind}' AS kind, {rule.least} AS least, "
            f"unnest(regexp_extract_all(body, {pattern}, 0)) AS m, unnest({tested}) AS t, "
            f"unnest(string_split_regex(body, {pattern})[:-2]) AS p, "
            f"unnest(range(len(regexp_extract_all(body, {pattern}, 0)))) AS n "
            f"FROM docs WHERE regexp_matches(body, {pattern})"
        )
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE_RULES)
    kinds = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE_RULES)
    return f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row_no, {body} AS body FROM documents),
found AS ({" UNION ALL ".join(found)}),
placed AS (
    SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY row_no, kind_no ORDER BY n)::BIGINT AS stop FROM found
),
kept AS (
    SELECT row_no, kind_no, kind, stop - length(m) AS start, kind || ':' || (stop - length(m)) || ':' || stop AS span
    FROM placed WHERE length(t) >= least
),
texts AS (
    SELECT row_no, {kinds}, string_agg(span, ',' ORDER BY start, kind_no) AS spans,
        string_agg(span, ',' ORDER BY start, kind_no) FILTER (kind IN ({base})) AS base
    FROM kept GROUP BY row_no
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN texts USING (row_no)
"""


def _op11():
    """The least (cost, audit) from every row and output to the end, from the last row backwards; then the audit is played."""
    go = (2, 2, 3, 2)
    keep = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    # a cost of ten digits before the audit: the least string is the least cost, then the least audit
    add = "lpad((left({0}, 10)::BIGINT + {1})::VARCHAR, 10, '0') || '{2}' || substr({0}, 11)"

    def row(output):
        kept = " ".join(f"WHEN ini = '{x}' THEN " + add.format(f"p{to[output]}", "5 * truncated", "K") for x, to in keep.items() if output in to)
        kept = f"CASE WHEN must THEN NULL {kept} END" if kept else "NULL::VARCHAR"
        role = f"CASE WHEN NOT must THEN {add.format(f'p{go[output]}', '1 + 5 * truncated', 'R')} END"
        return f"least({add.format(f'p{output}', 2, 'D')}, {kept}, {role})"

    def more(names):
        once = [f"least({n}, {add.format(names[go[o]], 5, 'I')})" for o, n in enumerate(names)]
        return once

    def step(source, names, label):
        return f"SELECT * EXCLUDE ({', '.join(names)}), " + ", ".join(f"{e} AS p{o}" for o, e in enumerate(more(names))) + f" FROM ({source}) {label}"

    rows_ = "SELECT r.conv_id, r.pos, r.n, " + ", ".join(f"{row(o)} AS q{o}" for o in range(4))
    rows_ += " FROM dp JOIN faults r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.pos = dp.pos - 1"
    names = ("q0", "q1", "q2", "q3")
    end = "0" * 10
    return f"""
WITH RECURSIVE bytes AS (
    SELECT list(list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS steps
    FROM range(256) t(i)
), named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, 
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(
            coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
            lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1])), 4294967295::BIGINT) % 20 AS fate
    FROM conversations, bytes
), rows AS (
    SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
        CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM named WHERE fate <> 0
), placed AS (
    SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS ini,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
        regexp_extract(text, '([^ \t\n\x0B\f\r])[ \t\n\x0B\f\r]*$', 1) AS final,
        left(role, 1) || lead(left(role, 1)) OVER w AS pair
    FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), faults AS (
    SELECT *, final = '' AS is_blank, final <> '' AND seen > 1 AS is_duplicate,
        (final <> '' AND seen = 1 AND final NOT IN ('.', '!', '?'))::INT AS truncated, final = '' OR seen > 1 AS must
    FROM placed
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_duplicate) AS duplicate, sum(truncated)::BIGINT AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(n) + 1 AS behind
    FROM faults GROUP BY conv_id
), dp AS (
    SELECT conv_id, behind AS pos, behind - 1 AS n, '{end}' AS p0, '0000000010II' AS p1, '0000000005I' AS p2, '{end}' AS p3 FROM counted
    UNION ALL
    {step(step(rows_, names, 'a'), ('p0', 'p1', 'p2', 'p3'), 'b')}
), solved AS (
    SELECT conv_id, left(p0, 10)::BIGINT AS cost, substr(p0, 11) AS audit FROM dp WHERE pos = 1
), edits AS (
    SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS place FROM solved
), played AS (
    SELECT *, count(*) FILTER (edit <> 'I') OVER w AS pos, count(*) FILTER (edit <> 'D') OVER w AS made FROM edits
    WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)
), left_in AS (
    SELECT e.conv_id, e.place, e.made, e.edit, r.role, r.text, e.made = 1 AND e.edit = 'K' AND r.ini = 's' AS system
    FROM played e LEFT JOIN faults r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.pos = e.pos AND e.edit <> 'I'
    WHERE e.edit <> 'D'
), said AS (
    SELECT *, CASE WHEN edit = 'K' THEN role
        WHEN (made - max(system::INT) OVER (PARTITION BY conv_id)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, '') AS line
    FROM left_in
), whole AS (
    SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY place)) AS sha FROM said GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
    coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counted t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM c.conv_id
"""


_OP12 = """
WITH rows AS (
    SELECT vec_id, list_transform(embedding, lambda c: floor(c::DOUBLE * 64)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
    FROM (SELECT * FROM rows WHERE vec_id % 20 = 0) q JOIN rows c ON q.vec_id <> c.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""


ORACLES = {"op11_conversation_repair": _op11(), "op12_exact_top_k": _OP12, "op1_chat_formatting": _OP1, "op5_license_scans": _op5(), "op6_secret_scans": _op6()}
