"""SQL with the meaning of each catalogued query, for a comparison on another engine."""

import re

from .. import config
from ..functions.text import _WS_CODES
from ..sources import adapters as V
from . import catalog as C

_WS = "".join(f"\\x{{{code:x}}}" for code in _WS_CODES)
_CJK = r"\p{Han}\p{Katakana}\p{Hiragana}"
_SPACES = "||".join(f"chr({code})" for code in _WS_CODES)


def _in(words):
    return ", ".join(f"'{w}'" for w in words)


def _stages(source, stages):
    for stage in stages:
        columns = ", ".join(f"{sql} AS {name}" for name, sql in stage.items())
        source = f"(SELECT *, {columns} FROM {source})"
    return source


def _id(*parts):
    joined = " || chr(31) || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"substr(sha256({joined}), 1, 32)"


_ROLES = "|".join(sorted(config.ATTENDEE_ROLES, key=len, reverse=True))
_BIGRAMS = "|".join(config.ORGANISATION_BIGRAMS)


def _person(raw):
    """Steps of the person-name rule as nested subselects over a source with ``raw``."""
    posts = ", ".join(
        f"CASE WHEN strpos(post, '{r}') > 0 THEN strpos(post, '{r}') - 1 + {len(r)} ELSE 0 END"
        for r in config.ATTENDEE_ROLES
    )
    return f"""(SELECT *, substr(regexp_replace(s3, '^(.{{2,}}?)({_BIGRAMS}).*$', '\\1', 's'), 1, 6) AS person
    FROM (SELECT *, CASE WHEN regexp_matches(s2, '^[・（(0-9０-９]') THEN s2
            ELSE regexp_extract(s2, '^[^・（(0-9０-９]*') END AS s3
    FROM (SELECT *, CASE WHEN post IS NULL THEN s1
            WHEN known > 0 THEN substr(post, known + 1)
            ELSE substr(post, length(regexp_extract(post, '^.*?[長監者]')) + 1) END AS s2
    FROM (SELECT *, greatest({posts}) AS known
    FROM (SELECT *, CASE WHEN s1 LIKE '兼%' THEN substr(s1, 2) END AS post
    FROM (SELECT *, CASE WHEN raw LIKE '補佐%' THEN substr(raw, 3) ELSE raw END AS s1 FROM {raw}))))))"""


def _compact_family(name):
    return f"""CASE WHEN length({name}) <= 2 THEN {name}
        WHEN substr({name}, 1, 1) IN ({_in(config.ONE_CHAR_FAMILY_NAMES)}) THEN substr({name}, 1, 1)
        ELSE substr({name}, 1, 2) END"""


def _spaced_family(name):
    parts = f"regexp_split_to_array(trim({name}, {_SPACES}), '[{_WS}]+')"
    return f"""CASE WHEN len({parts}) <= 1 THEN regexp_replace({name}, '[{_WS}]+', '', 'g')
        WHEN len({parts}) > 2 AND len(list_filter({parts}, lambda x: length(x) <> 1)) = 0
            THEN {parts}[1] || {parts}[2]
        ELSE {parts}[1] END"""


# Entries of one official line: role and the text up to the next role.
_OFFICIALS = f"""(SELECT *, unnest(names) AS raw, unnest(roles) AS role, unnest(range(len(roles))) AS pos
    FROM (SELECT *, regexp_extract_all(compact, '({_ROLES})', 1) AS roles,
            regexp_split_to_array(compact, '{_ROLES}')[2:] AS names
        FROM (SELECT *, regexp_replace(line, '[{_WS}]+', '', 'g') AS compact FROM @SOURCE@)))"""
_SEATS = f"""(SELECT *, trim(regexp_extract(chunk, '^.*?([０-９{_WS}]+)番(.*)$', 2, 's'), {_SPACES}) AS spaced,
        regexp_extract(chunk, '^.*?([０-９{_WS}]+)番(.*)$', 1, 's') AS seat
    FROM (SELECT *, trim(chunk0, {_SPACES}) AS chunk FROM (SELECT *, unnest(chunks) AS chunk0, unnest(range(len(chunks))) AS pos
        FROM (SELECT *, string_split(regexp_replace(line, '([{_CJK}][{_WS}]*)([０-９])', '\\1' || chr(10) || '\\2', 'g'), chr(10)) AS chunks FROM @SOURCE@)))
    WHERE regexp_matches(chunk, '[０-９{_WS}]+番'))"""

_SEAT_ROWS = f"""SELECT document_id, page, line_no, pos, regexp_replace(spaced, '[{_WS}]+', '', 'g') AS full_name,
    {_spaced_family('spaced')} AS family_name, '議員' AS role,
    try_cast(translate(regexp_replace(seat, '[{_WS}]+', '', 'g'), '０１２３４５６７８９', '0123456789') AS INT) AS seat_number,
    @CATEGORY@ AS category
    FROM {_SEATS} WHERE length(regexp_replace(spaced, '[{_WS}]+', '', 'g')) >= 2"""
_OFFICIAL_ROWS = f"""SELECT document_id, page, line_no, pos, person AS full_name, {_compact_family('person')} AS family_name,
    role, CAST(NULL AS INT) AS seat_number, @CATEGORY@ AS category
    FROM {_person(_OFFICIALS)} WHERE length(person) >= 2"""


def _rows(body, category, source):
    return body.replace("@CATEGORY@", category).replace("@SOURCE@", source)


CTES = {
    # --- table views
    "a_municipalities": """SELECT n_nationkey AS municipality_id, n_name AS name_ja, lower(n_name) AS name_en,
        r_name AS prefecture_ja FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""",
    "a_orders": "SELECT o.*, c_nationkey, c_mktsegment FROM orders o JOIN customer ON o_custkey = c_custkey",
    "a_documents": f"""SELECT o_orderkey AS document_id, c_nationkey AS municipality_id,
        c_nationkey || '-' || {V.FISCAL_YEAR} || '-' || {V.SESSION_TYPE} AS session_id,
        'Document ' || o_orderkey AS title, {V.STATUS} AS status, o_orderdate AS created_at FROM a_orders""",
    "a_sessions": f"""SELECT *, municipality_id || '-' || fiscal_year || '-' || session_type AS session_id,
        fiscal_year || ' ' || session_type AS session_name
        FROM (SELECT DISTINCT c_nationkey AS municipality_id, {V.FISCAL_YEAR} AS fiscal_year,
            {V.SESSION_TYPE} AS session_type FROM a_orders)""",
    "a_assets": """SELECT o_orderkey AS document_id, 'store/' || o_orderkey || '.pdf' AS storage_path,
        sha256(CAST(o_orderkey AS VARCHAR)) AS content_sha256, o_orderdate AS downloaded_at
        FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'""",
    "items": f"""SELECT *, l_orderkey AS document_id, CAST(row_number() OVER (PARTITION BY l_orderkey
        ORDER BY {', '.join(V.ITEM_ORDER)}) - 1 AS INT) AS sequence FROM lineitem""",
    "a_speeches": """SELECT document_id, sequence, CASE WHEN l_returnflag <> 'R' THEN l_suppkey END AS speaker_id,
        'S' || l_suppkey AS speaker_name_raw,
        repeat(concat_ws(' ', 'part', l_partkey, l_returnflag, l_linestatus), CASE WHEN l_partkey % 10 = 0 THEN 60 ELSE 1 END) AS speech_text FROM items""",
    "a_speakers": f"""SELECT s_suppkey AS speaker_id, s_nationkey AS municipality_id, s_name AS name_ja,
        {V.SPEAKER_ROLE} AS role FROM supplier""",
    "a_summaries": """SELECT o_orderkey AS document_id, 'Summary of ' || o_orderkey AS summary_text,
        CASE WHEN o_totalprice < 50000 THEN NULL WHEN o_orderpriority = '4-NOT SPECIFIED' THEN []
        ELSE [c_mktsegment, substr(o_orderpriority, 3), 'month ' || month(o_orderdate), 'desk ' || (o_custkey % 97)]
            || CASE WHEN o_totalprice > 300000 THEN [c_mktsegment] ELSE [] END END AS topics,
        o_orderdate AS created_at FROM a_orders WHERE o_orderstatus = 'F'""",
    "counts": "SELECT document_id, count(*) AS speech_count FROM a_speeches GROUP BY document_id",
    "stats": """SELECT m.municipality_id,
        (SELECT count(*) FROM a_documents d WHERE d.municipality_id = m.municipality_id) AS documents,
        (SELECT count(*) FROM a_speeches s JOIN a_documents d USING (document_id) WHERE d.municipality_id = m.municipality_id) AS speeches,
        (SELECT count(*) FROM a_speakers p WHERE p.municipality_id = m.municipality_id) AS speakers,
        (SELECT count(*) FROM a_summaries JOIN a_documents d USING (document_id) WHERE d.municipality_id = m.municipality_id) AS summaries
        FROM a_municipalities m""",
    "ranking": """SELECT p.municipality_id, row_number() OVER (PARTITION BY p.municipality_id
            ORDER BY count(s.document_id) DESC, p.speaker_id) AS rank,
        p.name_ja AS name, p.role, count(s.document_id) AS count
        FROM a_speakers p LEFT JOIN a_speeches s USING (speaker_id)
        GROUP BY p.municipality_id, p.speaker_id, p.name_ja, p.role""",
    "topic_rows": """SELECT d.municipality_id, d.session_id, s.document_id, unnest(s.topics) AS topic
        FROM a_summaries s JOIN a_documents d USING (document_id)""",
    "topic_years": """SELECT DISTINCT d.municipality_id, n.fiscal_year FROM a_summaries s
        JOIN a_documents d USING (document_id) JOIN a_sessions n USING (session_id) WHERE s.topics IS NOT NULL""",
    "top_topics": """SELECT municipality_id, topic, row_number() OVER (PARTITION BY municipality_id
            ORDER BY count(*) DESC, topic) AS rank FROM topic_rows GROUP BY municipality_id, topic QUALIFY rank <= 8""",
    "trends": """SELECT y.municipality_id, y.fiscal_year, 'R' || (y.fiscal_year - 2018) AS year, t.rank, t.topic,
        (SELECT count(*) FROM topic_rows r JOIN a_sessions n USING (session_id) WHERE r.municipality_id = y.municipality_id
            AND n.fiscal_year = y.fiscal_year AND r.topic = t.topic) AS count
        FROM topic_years y JOIN top_topics t USING (municipality_id)""",
    "doc_list": """SELECT d.municipality_id, d.document_id, d.title, d.status, CAST(d.created_at AS VARCHAR) AS created_at,
        n.fiscal_year, n.session_name, n.session_type, CASE n.session_type WHEN 'regular' THEN '定例会'
            WHEN 'extra' THEN '臨時会' WHEN 'committee' THEN '委員会' WHEN 'budget_committee' THEN '予算委員会' ELSE 'その他' END AS session_label,
        s.summary_text, array_to_string(s.topics, '|') AS topics, coalesce(c.speech_count, 0) AS speech_count
        FROM a_documents d LEFT JOIN a_sessions n USING (session_id)
        LEFT JOIN a_summaries s USING (document_id) LEFT JOIN counts c USING (document_id)""",
    # --- minutes texts
    "people": "SELECT * FROM " + _stages(
        "(SELECT o_orderkey AS key, o_orderstatus AS status, o_orderpriority AS priority FROM orders)", V.PREAMBLE_STAGES[:1]),
    "jp_pages": "SELECT key AS document_id, 1 AS page, text FROM " + _stages(
        "(SELECT o_orderkey AS key, o_orderstatus AS status, o_orderpriority AS priority FROM orders)", V.PREAMBLE_STAGES)
        + " UNION ALL SELECT key AS document_id, page, text FROM " + _stages(
        "(SELECT l_orderkey AS key, l_partkey AS part, l_suppkey AS supplier, l_returnflag || l_linestatus AS flag, sequence + 2 AS page FROM items)", V.SPEECH_STAGES),
    "jp_raw": """SELECT document_id, page, unnest(range(len(l))) AS line_no, unnest(l) AS raw_line
        FROM (SELECT document_id, page, string_split(text, chr(10)) AS l FROM jp_pages)""",
    "jp_lines": f"""SELECT document_id, page, line_no, rtrim(raw_line, {_SPACES}) AS line FROM jp_raw
        WHERE NOT regexp_matches(raw_line, '^[{_WS}]*[0-9]+[{_WS}]*$') AND rtrim(raw_line, {_SPACES}) <> ''
        AND NOT regexp_full_match(rtrim(raw_line, {_SPACES}), '[～~○◯{_WS}]+')""",
    "speech_roles": "SELECT * FROM (VALUES " + ", ".join(
        f"('{r}', {at})" for at, r in enumerate(config.SPEECH_ROLES)) + ") AS v(role, listed_at)",
    "circle_lines": f"""SELECT *, substr(line, 2) AS after, regexp_replace(substr(line, 2), '[{_WS}]+', '', 'g') AS norm
        FROM jp_lines WHERE line LIKE '○%'""",
    "role_hits": f"""SELECT document_id, page, line_no, after, strpos(norm, role) - 1 AS before, length(role) AS size
        FROM circle_lines, speech_roles WHERE strpos(norm, role) BETWEEN 2 AND 9
        AND regexp_full_match(substr(norm, 1, strpos(norm, role) - 1), '[{_CJK}()（）]+')
        QUALIFY row_number() OVER (PARTITION BY document_id, page, line_no ORDER BY before, size DESC) = 1""",
    "marks": f"""SELECT c.document_id, c.page, c.line_no, c.line,
        CASE WHEN h.after IS NOT NULL THEN substr(h.after, 1,
            list_filter(range(1, length(h.after) + 1), lambda i: NOT regexp_matches(substr(h.after, i, 1), '[{_WS}]'))[h.before + h.size])
        WHEN regexp_matches(c.line, '^○[{_CJK}]{{1,10}}([{_WS}]+[{_CJK}]{{1,5}})*$') THEN c.after END AS speaker_name_raw
        FROM circle_lines c LEFT JOIN role_hits h USING (document_id, page, line_no)""",
    "marked": f"""SELECT *, CASE WHEN speaker_name_raw IS NOT NULL
        THEN trim(substr(line, 2 + length(speaker_name_raw)), {_SPACES}) END AS rest FROM marks""",
    "segmented": """SELECT l.document_id, l.page, l.line_no, m.speaker_name_raw AS mark, m.speaker_name_raw,
        CASE WHEN m.speaker_name_raw IS NULL THEN l.line ELSE m.rest END AS piece,
        count(m.speaker_name_raw) OVER (PARTITION BY l.document_id ORDER BY l.page, l.line_no) AS segment
        FROM jp_lines l LEFT JOIN marked m USING (document_id, page, line_no)""",
    "raw_speeches": f"""SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY segment) - 1 AS INT) AS sequence FROM (
        SELECT document_id, segment, max(mark) AS speaker_name_raw, min(page) AS page_start, max(page) AS page_end,
        trim(string_agg(piece, chr(10) ORDER BY page, line_no) FILTER (WHERE piece <> ''), {_SPACES}) AS speech_text
        FROM segmented WHERE segment > 0 GROUP BY document_id, segment) WHERE speech_text <> ''""",
    "name_parts": f"""SELECT DISTINCT ON (raw) raw, norm, coalesce(role, '') AS speaker_role,
        substr(norm, 1, length(norm) - length(coalesce(role, ''))) AS speaker_name,
        CASE WHEN role IS NOT NULL THEN 'high' WHEN norm <> '' THEN 'medium' ELSE 'low' END AS parse_confidence
        FROM (SELECT DISTINCT speaker_name_raw AS raw, regexp_replace(speaker_name_raw, '[{_WS}]+', '', 'g') AS norm
            FROM marked WHERE speaker_name_raw IS NOT NULL) n
        LEFT JOIN speech_roles r ON suffix(n.norm, r.role) AND length(n.norm) > length(r.role) ORDER BY raw, listed_at""",
    "jp_speeches": """SELECT s.document_id, s.speaker_name_raw, s.page_start, s.page_end, s.speech_text, s.sequence,
        n.speaker_role, n.speaker_name, n.parse_confidence FROM raw_speeches s JOIN name_parts n ON n.raw = s.speaker_name_raw""",
    "preamble": f"""SELECT r.document_id, r.page, r.line_no, r.raw_line AS line FROM jp_raw r
        JOIN (SELECT document_id, min((page, line_no)) AS stop FROM jp_raw WHERE ltrim(raw_line, {_SPACES}) LIKE '○%' GROUP BY document_id) f
        USING (document_id) WHERE (r.page, r.line_no) < f.stop""",
    "sections": f"""SELECT document_id, page, line_no, line, event AS section_event,
        nullif(last_value(event IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page, line_no), '-') AS section
        FROM (SELECT *, CASE WHEN compact LIKE '%出席議員%' OR compact LIKE '%出席委員%' THEN 'councilor'
            WHEN compact LIKE '%説明のため出席した者%' OR compact LIKE '%規定により出席した者%' THEN 'executive'
            WHEN compact LIKE '%事務局の職氏名%' OR compact LIKE '%事務局職員%' THEN 'staff'
            WHEN regexp_matches(line, '^[０-９{_WS}]*[３-９]．') THEN '-' END AS event
        FROM (SELECT document_id, page, line_no, trim(line, {_SPACES}) AS line, regexp_replace(line, '[{_WS}]+', '', 'g') AS compact
            FROM preamble WHERE trim(line, {_SPACES}) <> ''))""",
    "listed": """SELECT *, section = 'councilor' AND regexp_matches(line, '[０-９]') AND line LIKE '%番%' AS seated
        FROM sections WHERE section IS NOT NULL AND section_event IS NULL""",
    "jp_attendees": _rows(_SEAT_ROWS, "section", "(SELECT * FROM listed WHERE seated)")
        + " UNION ALL " + _rows(_OFFICIAL_ROWS, "section", "(SELECT * FROM listed WHERE NOT seated)"),
    # --- speakers
    "people_docs": "SELECT p.*, d.municipality_id, d.created_at, d.document_id FROM people p JOIN a_documents d ON d.document_id = p.key",
    "known_people": f"""SELECT a.*, d.municipality_id, d.created_at, {_id('d.municipality_id', 'a.full_name')} AS speaker_id
        FROM jp_attendees a JOIN a_documents d USING (document_id)""",
    "coded": """SELECT *, CASE WHEN role = '議員' THEN 'councilor' WHEN role = '市長' THEN 'mayor'
        WHEN role IN ('副市長', '教育長') THEN 'executive' WHEN role IN ('議長', '副議長') OR role LIKE '%委員長%' THEN 'chair'
        WHEN regexp_matches(role, '部長|課長|局長|参事|次長|監査委員|危機管理監') THEN 'staff' ELSE 'unknown' END AS code FROM known_people""",
    "incoming": """SELECT municipality_id, full_name AS name_ja,
        coalesce(first(code ORDER BY created_at, document_id, page, line_no, pos) FILTER (WHERE code <> 'unknown'), 'unknown') AS role
        FROM coded GROUP BY municipality_id, full_name""",
    "stored_speakers": """SELECT municipality_id, n0 AS name_ja, 'old-' || municipality_id || '-' || n0 AS speaker_id,
        CASE WHEN min(status) = 'F' THEN 'unknown' ELSE 'executive' END AS role FROM people_docs GROUP BY municipality_id, n0""",
    "unique_family": """SELECT document_id, family_name, min(full_name) AS full_name FROM jp_attendees
        GROUP BY document_id, family_name HAVING count(*) = 1""",
    "new_aliases": """SELECT municipality_id, document_id, page, line_no, pos, 0 AS part, created_at, speaker_id, full_name AS alias_raw,
            full_name AS alias_norm, 'attendee_derived' AS alias_type, 1.0::DOUBLE AS confidence FROM known_people
        UNION ALL SELECT municipality_id, document_id, page, line_no, pos, 1, created_at, speaker_id, family_name, family_name,
            'attendee_derived', 0.8::DOUBLE FROM known_people""",
    "stored_aliases": f"""SELECT municipality_id, fam AS alias_norm, fam AS alias_raw, {_id('municipality_id', 'min(n1)')} AS speaker_id,
        CASE WHEN substr(fam, 2, 1) IN ('田', '山', '川') THEN 'manual' ELSE 'speech_derived' END AS alias_type, 0.5::DOUBLE AS confidence
        FROM (SELECT *, substr(n1, 1, 2) AS fam FROM people_docs) GROUP BY municipality_id, fam""",
    # Stored types are manual or speech_derived and new ones attendee_derived, so an alias
    # changes hands at most once: from a speech_derived owner to the first other attendee.
    "takers": """SELECT n.municipality_id, n.alias_norm, n.speaker_id, n.alias_raw, n.alias_type, n.confidence,
        n.created_at AS from_at, n.document_id AS from_doc
        FROM new_aliases n LEFT JOIN stored_aliases s USING (municipality_id, alias_norm)
        WHERE s.alias_type IS NULL OR (s.alias_type = 'speech_derived' AND s.speaker_id <> n.speaker_id)
        QUALIFY row_number() OVER (PARTITION BY n.municipality_id, n.alias_norm
            ORDER BY n.created_at, n.document_id, n.page, n.line_no, n.pos, n.part) = 1""",
    "owners": """SELECT t.*, CAST(NULL AS TIMESTAMP) AS to_at, CAST(NULL AS BIGINT) AS to_doc FROM takers t
        UNION ALL SELECT s.municipality_id, s.alias_norm, s.speaker_id, s.alias_raw, s.alias_type, s.confidence,
            TIMESTAMP '0001-01-01', -1, t.from_at, t.from_doc
        FROM stored_aliases s LEFT JOIN takers t USING (municipality_id, alias_norm)""",
    "name_rows": f"""SELECT DISTINCT s.document_id, s.speaker_name AS name_norm, d.municipality_id, d.created_at
        FROM jp_speeches s JOIN a_documents d USING (document_id)""",
    "ids": f"""SELECT document_id, full_name, min(speaker_id) AS speaker_id, min((page, line_no, pos)) AS ord
        FROM known_people GROUP BY document_id, full_name""",
    "resolved_names": """SELECT document_id, name_norm, municipality_id, speaker_id, full_name,
            CASE strategy WHEN 'unresolved' THEN 'low' WHEN 'prefix' THEN 'medium' ELSE 'high' END AS confidence, strategy AS match_strategy
        FROM (
        SELECT document_id, name_norm, municipality_id, i.speaker_id, i.full_name, 'exact_fullname' AS strategy, 1 AS step
            FROM name_rows n JOIN ids i USING (document_id) WHERE i.full_name = n.name_norm
        UNION ALL SELECT document_id, name_norm, municipality_id, i.speaker_id, i.full_name, 'exact_family', 2
            FROM name_rows n JOIN unique_family u USING (document_id) JOIN ids i USING (document_id, full_name) WHERE u.family_name = n.name_norm
        UNION ALL SELECT n.document_id, n.name_norm, n.municipality_id, o.speaker_id, i.full_name, 'alias_norm', 3
            FROM name_rows n JOIN owners o ON o.municipality_id = n.municipality_id AND o.alias_norm = n.name_norm
                AND (o.from_at, o.from_doc) <= (n.created_at, n.document_id)
                AND (o.to_at IS NULL OR (o.to_at, o.to_doc) > (n.created_at, n.document_id))
            LEFT JOIN ids i ON i.document_id = n.document_id AND i.speaker_id = o.speaker_id
        UNION ALL (SELECT document_id, name_norm, municipality_id, i.speaker_id, i.full_name, 'paren_hint', 4
            FROM name_rows n JOIN ids i USING (document_id)
            WHERE regexp_matches(name_norm, '^.+[（(].+[）)]$')
                AND starts_with(i.full_name, regexp_extract(name_norm, '^(.+)[（(](.+)[）)]$', 1))
                AND length(i.full_name) > length(regexp_extract(name_norm, '^(.+)[（(](.+)[）)]$', 1))
                AND contains(i.full_name, regexp_extract(name_norm, '^(.+)[（(](.+)[）)]$', 2))
            QUALIFY row_number() OVER (PARTITION BY document_id, name_norm ORDER BY i.ord) = 1)
        UNION ALL SELECT document_id, name_norm, any_value(municipality_id), min(i.speaker_id), min(i.full_name), 'prefix', 5
            FROM name_rows n JOIN unique_family u USING (document_id) JOIN ids i USING (document_id, full_name)
            WHERE length(u.family_name) >= 2 AND starts_with(n.name_norm, u.family_name) GROUP BY document_id, name_norm HAVING count(*) = 1
        UNION ALL SELECT document_id, name_norm, municipality_id, NULL, NULL, 'unresolved', 6 FROM name_rows)
        QUALIFY row_number() OVER (PARTITION BY document_id, name_norm ORDER BY step) = 1""",
    "resolved": f"""SELECT {_id('s.document_id', 's.sequence')} AS speech_id, s.*, r.name_norm, r.speaker_id, r.match_strategy,
        CASE r.confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.3 END::DOUBLE AS confidence
        FROM jp_speeches s JOIN resolved_names r ON r.document_id = s.document_id AND r.name_norm = s.speaker_name""",
    "variants": f"""SELECT document_id, municipality_id, {C.VARIANT} AS name_ja FROM people_docs""",
    "variant_ids": f"SELECT *, {_id('municipality_id', 'name_ja')} AS speaker_id FROM variants",
    "variant_speakers": "SELECT DISTINCT municipality_id, name_ja, speaker_id FROM variant_ids",
    "groups": """SELECT d.municipality_id, d.speaker_id AS duplicate_id, d.name_ja AS duplicate_name,
        c.speaker_id AS canonical_id, c.name_ja AS canonical_name
        FROM variant_speakers d JOIN variant_speakers c ON c.municipality_id = d.municipality_id
            AND length(c.name_ja) >= 3 AND length(c.name_ja) < length(d.name_ja) AND starts_with(d.name_ja, c.name_ja)
        QUALIFY row_number() OVER (PARTITION BY d.municipality_id, d.speaker_id ORDER BY length(c.name_ja), c.speaker_id) = 1""",
    # --- words
    "tokens": r"""SELECT lang AS municipality_id, doc_id AS document_id, unnest(regexp_extract_all(text, '\p{L}+')) AS word FROM documents""",
    "kept": f"SELECT * FROM tokens WHERE length(word) >= 2 AND word NOT IN ({_in(C.STOP_WORDS)})",
    "words": """SELECT municipality_id, word, count(*) AS count, CAST(NULL AS VARCHAR) AS reading, '名詞/一般' AS part_of_speech
        FROM kept GROUP BY municipality_id, word""",
    "ranked_words": "SELECT *, row_number() OVER (PARTITION BY municipality_id ORDER BY count DESC, word) AS rank FROM words",
    "fresh_words": """SELECT municipality_id, word, count(*) AS count, CAST(NULL AS VARCHAR) AS reading, '名詞/一般' AS part_of_speech
        FROM kept WHERE document_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY municipality_id, word
        QUALIFY row_number() OVER (PARTITION BY municipality_id ORDER BY count(*) DESC, word) <= 500""",
    # --- summaries
    "turns": """SELECT conv_id AS document_id, CAST(turn AS INT) AS sequence, role AS speaker_name_raw, text AS speech_text,
        role || ': ' || text AS formatted, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10ffff}]', '', 'g')) AS units
        FROM conversations""".replace("\\\\", "\\"),
    "costs": """SELECT *, CAST(ceil((units + length(speaker_name_raw) + 4) / 2.0) AS INT) AS tokens,
        row_number() OVER (PARTITION BY document_id ORDER BY sequence) AS n FROM turns""",
    "packed": f"""SELECT document_id, sequence, n, tokens, tokens AS carry, 0 AS chunk FROM costs WHERE n = 1
        UNION ALL SELECT c.document_id, c.sequence, c.n, c.tokens,
            CASE WHEN p.carry + c.tokens > {C.REQUEST_LIMIT} THEN c.tokens ELSE p.carry + c.tokens END,
            p.chunk + CASE WHEN p.carry + c.tokens > {C.REQUEST_LIMIT} THEN 1 ELSE 0 END
        FROM packed p JOIN costs c ON c.document_id = p.document_id AND c.n = p.n + 1""",
    "routes": f"""SELECT document_id, count(*) AS speeches,
        CAST(ceil((sum(units + length(speaker_name_raw) + 2) + 2 * (count(*) - 1)) / 2.0) AS BIGINT) AS tokens,
        CASE WHEN ceil((sum(units + length(speaker_name_raw) + 2) + 2 * (count(*) - 1)) / 2.0) <= {C.REQUEST_LIMIT}
            THEN 'single' ELSE 'chunked' END AS route FROM turns GROUP BY document_id""",
    "replies": """SELECT conv_id AS document_id, CAST(turn AS INT) AS part, role, text,
        CASE WHEN role <> 'system' THEN text END AS summary, [role, 'topic "two"'] AS topics,
        CASE WHEN role = 'user' THEN [substr(text, 1, 20)] ELSE [] END AS key_points FROM conversations""",
    # --- state
    "outcomes": """SELECT municipality_id, municipality_id || '-' || year(created_at) AS run_id, title AS url,
        CASE WHEN session_id LIKE '%regular' AND status = 'downloaded' THEN 'failed' WHEN status = 'parsed' THEN 'skipped' ELSE 'done' END AS outcome,
        'broken ' || title AS error, created_at FROM a_documents""",
    "runs": """SELECT municipality_id, run_id, count(*) AS total, count(*) FILTER (outcome = 'done') AS done,
        count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed,
        min(created_at) AS started_at FROM outcomes GROUP BY municipality_id, run_id""",
}
_RECURSIVE = {"packed"}
#: Steps that are computed once, whatever reads them.
_ONCE = {"jp_pages", "jp_raw", "jp_lines", "circle_lines", "role_hits", "preamble"}
_NEEDS = {
    name: [other for other in CTES if other != name and re.search(rf"\b{other}\b", body)]
    for name, body in CTES.items()
}


def _sql(body: str) -> str:
    order = []

    def add(name):
        for other in _NEEDS[name]:
            add(other)
        if name not in order:
            order.append(name)

    for name in CTES:
        if re.search(rf"\b{name}\b", body):
            add(name)
    if not order:
        return body
    ctes = ", ".join(f"{name} AS {'MATERIALIZED ' if name in _ONCE else ''}({CTES[name]})" for name in order)
    return f"WITH {'RECURSIVE ' if _RECURSIVE & set(order) else ''}{ctes} {body}"


_DECODED = "url_decode(replace({0}, '+', '%2B'))"
_BASENAME = r"regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '([^/]*)/*$', 1)"


def _quoted(value):
    return f"CAST(to_json({value}) AS VARCHAR)"


def _pretty(values):
    inner = f"array_to_string(list_transform({values}, lambda v: '    ' || CAST(to_json(v) AS VARCHAR)), ',' || chr(10))"
    return f"CASE WHEN len({values}) = 0 THEN '[]' ELSE '[' || chr(10) || {inner} || chr(10) || '  ]' END"


_BODIES = {
    "dashboard_stats": "SELECT * FROM stats",
    "summary_coverage": """SELECT municipality_id, CASE WHEN documents = 0 THEN 0
        ELSE CAST(floor(100.0 * summaries / documents + 0.5) AS INT) END AS coverage FROM stats""",
    "recent_documents": """SELECT d.municipality_id, d.rank, d.document_id, d.title, CAST(d.created_at AS VARCHAR) AS created_at,
        s.summary_text, coalesce(array_to_string(s.topics, '|'), '') AS topics, coalesce(array_to_string(s.topics[1:3], '|'), '') AS head_topics, coalesce(c.speech_count, 0) AS speech_count
        FROM (SELECT *, row_number() OVER (PARTITION BY municipality_id ORDER BY created_at DESC, document_id DESC) AS rank FROM a_documents) d
        LEFT JOIN a_summaries s USING (document_id) LEFT JOIN counts c USING (document_id) WHERE d.rank <= 10""",
    "topic_frequency": """SELECT municipality_id, topic, count(*) AS count,
        row_number() OVER (PARTITION BY municipality_id ORDER BY count(*) DESC, topic) AS rank,
        CASE WHEN length(topic) > 10 THEN substr(topic, 1, 10) || '...' ELSE topic END AS label
        FROM topic_rows GROUP BY municipality_id, topic QUALIFY rank <= 15""",
    "speaker_ranking": "SELECT * FROM ranking WHERE rank <= 15",
    "dashboard_from_kept_counts": "SELECT * FROM stats",
    "speaker_ranking_from_kept_counts": "SELECT * FROM ranking WHERE rank <= 15",
    "speaker_stats": "SELECT * FROM ranking WHERE rank <= 30",
    "topic_trends": "SELECT * FROM trends",
    "topic_trends_pivot": "SELECT municipality_id, fiscal_year, year, "
        + ", ".join(f"CAST(sum(CASE WHEN rank = {at} THEN count ELSE 0 END) AS BIGINT) AS topic_{at}" for at in range(1, 9))
        + " FROM trends GROUP BY municipality_id, fiscal_year, year",
    "document_list": "SELECT * FROM doc_list",
    "document_list_filtered": "SELECT * FROM doc_list WHERE fiscal_year = 2021 AND session_type = 'regular'",
    "document_detail": """SELECT d.municipality_id, d.document_id, d.title, d.status, e.fiscal_year, e.session_type, s.summary_text,
        coalesce(array_to_string(s.topics, '|'), '') AS topics, p.sequence, p.speech_text,
        coalesce(k.name_ja, p.speaker_name_raw) AS name, coalesce(k.role, 'unknown') AS role,
        CASE WHEN length(p.speech_text) > 500 THEN substr(p.speech_text, 1, 500) || '...' ELSE p.speech_text END AS preview
        FROM a_documents d LEFT JOIN a_sessions e ON e.session_id = d.session_id LEFT JOIN a_summaries s USING (document_id)
        LEFT JOIN a_speeches p USING (document_id) LEFT JOIN a_speakers k ON k.speaker_id = p.speaker_id""",
    "speaker_breakdown": f"""SELECT d.municipality_id, p.document_id, p.speaker_id, coalesce(k.name_ja, '{config.UNKNOWN_SPEAKER}') AS name,
        coalesce(k.role, 'unknown') AS role, count(*) AS count
        FROM a_speeches p JOIN a_documents d USING (document_id) LEFT JOIN a_speakers k ON k.speaker_id = p.speaker_id GROUP BY ALL""",
    "fiscal_years": """SELECT DISTINCT municipality_id, fiscal_year,
        'R' || (fiscal_year - 2018) || '（' || fiscal_year || '）' AS option FROM a_sessions""",
    "session_types": """SELECT DISTINCT municipality_id, session_type, session_label AS label FROM doc_list""",
    "municipality_list": """SELECT m.municipality_id, name_ja, name_en, prefecture_ja, documents AS document_count,
        speakers AS speaker_count, documents = 0 AS in_preparation FROM a_municipalities m JOIN stats USING (municipality_id)""",
    "municipality_by_id": "SELECT * FROM a_municipalities WHERE municipality_id IN (SELECT municipality_id FROM a_documents)",
    "pending_documents": """SELECT d.document_id, d.municipality_id, d.session_id, d.title, d.status, CAST(d.created_at AS VARCHAR) AS created_at,
        a.storage_path, a.content_sha256, CASE WHEN a.document_id IS NULL THEN 'skipped' ELSE 'pending' END AS outcome
        FROM a_documents d LEFT JOIN a_assets a USING (document_id) WHERE d.status = 'downloaded'""",
    "parsed_documents": """SELECT municipality_id, document_id, title, CAST(created_at AS VARCHAR) AS created_at, coalesce(speech_count, 0) AS speech_count
        FROM a_documents LEFT JOIN counts USING (document_id) WHERE status = 'parsed'""",
    "unsummarized_documents": """SELECT municipality_id, document_id, title, CAST(created_at AS VARCHAR) AS created_at, coalesce(speech_count, 0) AS speech_count
        FROM a_documents LEFT JOIN counts USING (document_id) WHERE status = 'parsed'
        AND document_id NOT IN (SELECT document_id FROM a_summaries WHERE topics IS NOT NULL)""",
    "speeches_to_summarize": """SELECT document_id, sequence, speaker_name_raw, speech_text FROM a_speeches WHERE document_id IN (
        SELECT document_id FROM a_documents WHERE status = 'parsed'
        AND document_id NOT IN (SELECT document_id FROM a_summaries WHERE topics IS NOT NULL))""",
    "flatten_lines": f"""SELECT document_id, line_no, rtrim(line, {_SPACES}) AS line
        FROM (SELECT doc_id AS document_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
        WHERE NOT regexp_matches(line, '^[{_WS}]*[0-9]+[{_WS}]*$') AND rtrim(line, {_SPACES}) <> ''""",
    "separator_filter": "SELECT * FROM jp_lines",
    "segment_by_marker": f"""SELECT document_id, speech_text, CAST(row_number() OVER (PARTITION BY document_id ORDER BY segment) - 1 AS INT) AS sequence FROM (
        SELECT document_id, segment, trim(string_agg(line, chr(10) ORDER BY line_no), {_SPACES}) AS speech_text FROM (
            SELECT *, count(CASE WHEN regexp_matches(line, '{C.MARKER_PATTERN}') THEN 1 END) OVER (PARTITION BY document_id ORDER BY line_no) AS segment
            FROM (SELECT document_id, line_no, rtrim(line, {_SPACES}) AS line
                FROM (SELECT doc_id AS document_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
            WHERE line <> '' AND NOT regexp_full_match(trim(line, {_SPACES}), '[0-9]+') AND NOT regexp_full_match(line, '[～~○◯{_WS}]+'))
        WHERE segment > 0 GROUP BY document_id, segment) WHERE speech_text <> ''""",
    "speaker_line_match": "SELECT document_id, page, line_no, line, speaker_name_raw, rest FROM marked",
    "speaker_name_split": """SELECT m.speaker_name_raw, n.speaker_name, n.speaker_role, n.parse_confidence, count(*) AS lines
        FROM marked m JOIN name_parts n ON n.raw = m.speaker_name_raw GROUP BY ALL""",
    "segment_speeches": "SELECT * FROM jp_speeches",
    "preamble_lines": "SELECT * FROM preamble",
    "section_forward_fill": "SELECT * FROM sections",
    "parse_attendees": "SELECT * FROM jp_attendees",
    "councilor_lines": _rows(_SEAT_ROWS, "'councilor'", "preamble"),
    "official_lines": _rows(_OFFICIAL_ROWS, "'executive'", "preamble"),
    "truncate_name": f"SELECT key, raw, person AS name FROM {_person('(SELECT key, ' + C.PERSON_RAW + ' AS raw FROM people)')}",
    "family_name": f"""SELECT key, spaced, {_spaced_family('spaced')} AS from_spaced, {_compact_family('n1')} AS from_compact
        FROM (SELECT *, {C.SPACED_NAME} AS spaced FROM people)""",
    "suspicious_attendees": """SELECT document_id, count(*) AS attendees, count(*) FILTER (length(full_name) > 3) AS suspicious
        FROM jp_attendees GROUP BY document_id""",
    "normalize_alias": f"SELECT doc_id, sha256(regexp_replace(text, '[{_WS}]+', '', 'g')) AS compact_sha256 FROM documents",
    "zen_to_han": "SELECT document_id, line_no, translate(line, '０１２３４５６７８９', '0123456789') AS line FROM preamble",
    "role_map": "SELECT role, code, count(*) AS n FROM coded GROUP BY role, code",
    "confidence_values": """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END AS label,
        CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.7 ELSE 0.3 END::DOUBLE AS value FROM orders""",
    "section_and_document_type": """SELECT DISTINCT n.session_id, n.fiscal_year || '年 ' || l.session_label AS heading,
        CASE n.session_type WHEN 'regular' THEN 'regular' WHEN 'extra' THEN 'extra' WHEN 'other' THEN 'other' ELSE 'committee' END AS kind,
        CASE n.session_type WHEN 'regular' THEN 'minutes' WHEN 'extra' THEN 'minutes' WHEN 'other' THEN 'other' ELSE 'committee_minutes' END AS document_type
        FROM a_sessions n JOIN doc_list l USING (session_type)""",
    "speech_preview": """SELECT conv_id AS document_id, CAST(turn AS INT) AS sequence,
        CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS preview FROM conversations""",
    "speaker_upsert": f"""SELECT municipality_id, name_ja, coalesce(s.speaker_id, {_id('municipality_id', 'name_ja')}) AS speaker_id,
        CASE WHEN coalesce(s.role, 'unknown') <> 'unknown' THEN s.role ELSE coalesce(i.role, 'unknown') END AS role,
        s.speaker_id IS NULL AS is_new FROM stored_speakers s FULL JOIN incoming i USING (municipality_id, name_ja)""",
    "unique_family_names": "SELECT * FROM unique_family",
    "alias_generation": """SELECT municipality_id, document_id, line_no, pos, part, speaker_id, alias_raw, alias_norm, alias_type, confidence FROM new_aliases""",
    "alias_merge": """SELECT municipality_id, alias_norm, speaker_id, alias_raw, alias_type, confidence FROM owners WHERE to_at IS NULL""",
    "alias_dictionary": """SELECT municipality_id, alias_norm,
        first(speaker_id ORDER BY created_at, document_id, page, line_no, pos, part) AS speaker_id FROM new_aliases GROUP BY municipality_id, alias_norm""",
    "resolve_names": "SELECT * FROM resolved_names",
    "resolve_cascade": """SELECT speech_id, document_id, sequence, speaker_id, speaker_name_raw, speech_text, page_start, page_end,
        confidence, match_strategy FROM resolved""",
    "match_rate": """SELECT count(*) AS speeches, count(speaker_id) AS matched, count(*) - count(speaker_id) AS unmatched,
        round(count(speaker_id) * 100.0 / count(*), 1)::DOUBLE AS rate FROM resolved""",
    "match_rate_by_document": """SELECT document_id, count(*) AS speeches, count(speaker_id) AS matched, count(*) - count(speaker_id) AS unmatched,
        round(count(speaker_id) * 100.0 / count(*), 1)::DOUBLE AS rate FROM resolved GROUP BY document_id""",
    "unresolved_names": """SELECT name_norm, count(*) AS speeches, count(DISTINCT document_id) AS documents
        FROM resolved WHERE speaker_id IS NULL GROUP BY name_norm""",
    "shared_surname_hits": """SELECT r.document_id, r.name_norm, r.speaker_id, b.bearers FROM resolved_names r
        JOIN (SELECT document_id, family_name, count(DISTINCT speaker_id) AS bearers FROM known_people GROUP BY ALL) b
        ON b.document_id = r.document_id AND b.family_name = r.name_norm
        WHERE r.match_strategy = 'alias_norm' AND b.bearers > 1""",
    "prefix_merge": "SELECT * FROM groups",
    "repoint_speeches": """SELECT v.document_id, coalesce(g.canonical_id, v.speaker_id) AS speaker_id
        FROM variant_ids v LEFT JOIN groups g ON g.duplicate_id = v.speaker_id""",
    "merged_speakers": "SELECT * FROM variant_speakers WHERE speaker_id NOT IN (SELECT duplicate_id FROM groups)",
    "merge_report": """SELECT g.*, (SELECT count(*) FROM variant_ids v WHERE v.speaker_id = g.duplicate_id) AS moved_speeches FROM groups g""",
    "token_filter": "SELECT document_id, count(*) AS tokens, count(DISTINCT word) AS words FROM kept GROUP BY document_id",
    "word_frequencies": "SELECT * FROM words",
    "word_frequencies_by_delta": "SELECT * FROM words",
    "top_words_by_group": "SELECT municipality_id, word, count, reading, part_of_speech FROM ranked_words WHERE rank <= 500",
    "word_list": "SELECT municipality_id, word, count FROM ranked_words WHERE rank <= 200",
    "word_cloud_weights": """SELECT municipality_id, rank, word, count, CASE WHEN r > 0.7 THEN 'high' WHEN r > 0.4 THEN 'middle' ELSE 'low' END AS tier,
        round(r, 6) AS ratio, round(10 + r * 28, 4) AS font_size, round(0.4 + r * 0.6, 4) AS opacity
        FROM (SELECT *, (count - min(count) OVER g)::DOUBLE / CASE WHEN max(count) OVER g > min(count) OVER g THEN max(count) OVER g - min(count) OVER g ELSE 1 END AS r
            FROM ranked_words WHERE rank <= 200 WINDOW g AS (PARTITION BY municipality_id)) WHERE rank <= 100""",
    "replace_words": """SELECT municipality_id, word, count, reading, part_of_speech FROM ranked_words WHERE rank <= 500
        AND municipality_id NOT IN (SELECT municipality_id FROM fresh_words) UNION ALL SELECT * FROM fresh_words""",
    "replace_word_partitions": """SELECT municipality_id, word, count, reading, part_of_speech FROM ranked_words WHERE rank <= 500
        AND municipality_id NOT IN (SELECT municipality_id FROM fresh_words) UNION ALL SELECT * FROM fresh_words""",
    "token_estimate": "SELECT document_id, sequence, CAST(ceil(units / 2.0) AS BIGINT) AS tokens FROM turns",
    "route_documents": "SELECT * FROM routes",
    "chunk_packing": "SELECT document_id, sequence, tokens, chunk FROM packed",
    "format_document": """SELECT document_id, route, part, string_agg(formatted, chr(10) || chr(10) ORDER BY sequence) AS content, count(*) AS speeches,
        CAST(ceil((sum(units + length(speaker_name_raw) + 2) + 2 * (count(*) - 1)) / 2.0) AS BIGINT) AS tokens
        FROM (SELECT t.*, r.route, CASE r.route WHEN 'single' THEN 0 ELSE p.chunk END AS part
            FROM turns t JOIN routes r USING (document_id) JOIN packed p ON p.document_id = t.document_id AND p.sequence = t.sequence)
        GROUP BY document_id, route, part""",
    "chunk_totals": """SELECT document_id, CAST(sum(tokens) AS BIGINT) AS total_tokens, count(DISTINCT chunk) AS requests FROM packed GROUP BY document_id""",
    "parse_reply": """SELECT document_id, part, summary, CASE WHEN role <> 'system' THEN array_to_string(topics, '|') END AS topics,
        CASE WHEN role <> 'system' THEN array_to_string(key_points, '|') END AS key_points,
        CASE WHEN role = 'system' THEN 'reply is not JSON' END AS error FROM replies""",
    "merge_input": f"""SELECT document_id, count(*) AS parts, string_agg('## パート' || (part + 1) || 'の要約' || chr(10) ||
        '{{' || chr(10) || '  "summary": ' || {_quoted('summary')} || ',' || chr(10) || '  "topics": ' || {_pretty('topics')} || ',' || chr(10) ||
        '  "key_points": ' || {_pretty('key_points')} || chr(10) || '}}', chr(10) || chr(10) ORDER BY part) AS content
        FROM replies WHERE role <> 'system' GROUP BY document_id HAVING count(*) > 1""",
    "summary_upsert": """SELECT document_id, CASE WHEN d.document_id IS NOT NULL THEN 'New ' || d.title ELSE s.summary_text END AS summary_text,
        CAST(coalesce(s.created_at, TIMESTAMP '2030-01-01') AS VARCHAR) AS created_at
        FROM a_summaries s FULL JOIN (SELECT * FROM a_documents WHERE status <> 'discovered') d USING (document_id)""",
    "extract_links": f"""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INT) AS pos,
        CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '/%' THEN '{C.BASE_URL}' || href ELSE '{C.BASE_URL}/' || href END AS url,
        label AS title, 'other' AS section_kind
        FROM (SELECT page_id, unnest(range(len(hrefs))) AS n, unnest(hrefs) AS href, unnest(labels) AS label
            FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
                regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS labels FROM pages)) WHERE href LIKE '%/%'""",
    "url_columns": f"""SELECT page_id, substr(sha256(url), 1, 12) || '_' || {_DECODED.format(_BASENAME)} AS storage_name,
        {_DECODED.format("regexp_replace(regexp_extract(url, '[^/]*$'), '(?i)[.]pdf$', '')")} AS title,
        CASE WHEN url LIKE 'https://%' THEN '{C.BASE_URL}/' || substr(url, 9) ELSE url END AS absolute_url FROM pages""",
    "file_titles": """SELECT page_id, replace(replace(n, '-', ' '), '_', ' ') AS title, 'local://' || n || '.PDF' AS url
        FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[/?]', '_', 'g') AS n FROM pages)""",
    "content_fingerprint": "SELECT doc_id AS name, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes FROM documents",
    "content_diff": """SELECT d.doc_id AS name, sha256(d.text) AS sha256, CAST(strlen(d.text) AS BIGINT) AS bytes,
        CASE WHEN l.doc_id IS NULL THEN 'new' WHEN l.quality = 0 THEN 'changed' ELSE 'same' END AS state
        FROM documents d LEFT JOIN labels l USING (doc_id)""",
    # The files lie in the folder of the given tables, found by the number of line items.
    "scan_documents": """SELECT n AS name, 'local://' || n AS url, replace(replace(n, '-', ' '), '_', ' ') AS title, sha256, bytes
        FROM (SELECT parse_filename(filename) AS n, sha256(content) AS sha256, CAST(octet_length(content) AS BIGINT) AS bytes
            FROM read_blob('/root/testdata/sf*/*.parquet') WHERE parse_dirpath(filename) IN (
                SELECT parse_dirpath(file_name) FROM parquet_file_metadata('/root/testdata/sf*/lineitem.parquet')
                WHERE num_rows = (SELECT count(*) FROM lineitem)))""",
    "shared_content": """SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "reconstruct_pages": """SELECT document_id, 1 AS page, string_agg(CASE WHEN abs(y - before) > 20 THEN chr(10) ELSE '' END || str, '' ORDER BY sequence) AS text
        FROM (SELECT *, l_quantity AS y, lag(l_quantity) OVER (PARTITION BY document_id ORDER BY sequence) AS before, l_returnflag || l_partkey AS str FROM items)
        GROUP BY document_id""",
    "insert_if_absent": """SELECT 'doc/' || document_id AS url, CASE WHEN status = 'discovered' THEN upper(title) ELSE title END AS title, status,
        status = 'discovered' AS is_new FROM a_documents""",
    "upsert_latest": """SELECT document_id, coalesce(n.storage_path, a.storage_path) AS storage_path, coalesce(n.content_sha256, a.content_sha256) AS content_sha256,
        CAST(coalesce(n.downloaded_at, a.downloaded_at) AS VARCHAR) AS downloaded_at,
        CASE WHEN a.document_id IS NOT NULL THEN 'local' ELSE 'other' END AS provider
        FROM a_assets a FULL JOIN (SELECT l_orderkey AS document_id, 'new/' || l_partkey AS storage_path,
            sha256(CAST(l_partkey AS VARCHAR)) AS content_sha256, l_shipdate AS downloaded_at FROM lineitem
            QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, 'new/' || l_partkey DESC) = 1) n USING (document_id)""",
    "status_transitions": """SELECT d.document_id, CASE WHEN a.document_id IS NULL THEN d.status WHEN c.document_id IS NOT NULL THEN 'parsed'
        WHEN d.status = 'discovered' THEN 'downloaded' ELSE d.status END AS status
        FROM a_documents d LEFT JOIN a_assets a USING (document_id)
        LEFT JOIN (SELECT DISTINCT l_orderkey AS document_id FROM lineitem WHERE l_returnflag = 'A') c USING (document_id)""",
    "reset_status": "SELECT document_id, CASE status WHEN 'parsed' THEN 'downloaded' ELSE status END AS status FROM a_documents",
    "documents_to_fetch": "SELECT document_id, status FROM a_documents WHERE status = 'discovered'",
    "run_log": """SELECT run_id, total, done, skipped, failed, CASE WHEN failed = 0 THEN 'success' WHEN done > 0 THEN 'partial' ELSE 'failed' END AS status,
        '{"total":' || total || ',"done":' || done || ',"skipped":' || skipped || ',"failed":' || failed || '}' AS log FROM runs""",
    "run_log_with_errors": """SELECT run_id, total, done, skipped, failed, CASE WHEN failed = 0 THEN 'success' WHEN done > 0 THEN 'partial' ELSE 'failed' END AS status,
        '{"total":' || total || ',"done":' || done || ',"skipped":' || skipped || ',"failed":' || failed || ',"errors":[' || coalesce(errors, '') || ']}' AS log
        FROM runs LEFT JOIN (SELECT run_id, string_agg('{"url":"' || url || '","error":"' || error || '"}', ',' ORDER BY url, error) AS errors
            FROM outcomes WHERE outcome = 'failed' GROUP BY run_id) USING (run_id)""",
    "run_errors": "SELECT run_id, url, error FROM outcomes WHERE outcome = 'failed'",
    "step_counters": """SELECT municipality_id, CAST(sum(total) AS BIGINT) AS total, CAST(sum(done) AS BIGINT) AS done, CAST(sum(skipped) AS BIGINT) AS skipped,
        CAST(sum(failed) AS BIGINT) AS failed FROM runs GROUP BY municipality_id""",
    "recent_runs": "SELECT municipality_id, run_id, CAST(started_at AS VARCHAR) AS started_at FROM runs",
    "replace_partitions": """SELECT document_id, sequence, CASE WHEN d.status = 'parsed' THEN upper(speech_text) ELSE speech_text END AS speech_text
        FROM a_speeches LEFT JOIN a_documents d USING (document_id)""",
    "replaced_speeches": """SELECT CAST(d.municipality_id AS VARCHAR) AS municipality_id, CAST(document_id AS VARCHAR) AS document_id, sequence,
        speaker_name_raw, CASE WHEN d.status = 'parsed' THEN upper(speech_text) ELSE speech_text END AS speech_text,
        CAST(sequence + 2 AS INT) AS page_start FROM a_speeches JOIN a_documents d USING (document_id)""",
    "document_by_id": """SELECT CAST(d.municipality_id AS VARCHAR) AS municipality_id, CAST(d.document_id AS VARCHAR) AS document_id, d.title, d.status,
        e.fiscal_year, e.session_name, e.session_type, s.summary_text, coalesce(array_to_string(s.topics, '|'), '') AS topics,
        'dated ' || substr(CAST(d.created_at AS VARCHAR), 1, 10) || '|' || s.summary_text AS key_points, p.sequence,
        coalesce(k.name_ja, p.speaker_name_raw) AS name, coalesce(k.role, 'unknown') AS role, p.speech_text,
        CAST(p.sequence + 2 AS INT) AS page_start, CAST(p.sequence + 2 AS INT) AS page_end
        FROM (SELECT * FROM a_documents WHERE status = 'parsed' ORDER BY created_at DESC, document_id DESC LIMIT 1) d
        LEFT JOIN a_sessions e ON e.session_id = d.session_id LEFT JOIN a_summaries s USING (document_id)
        LEFT JOIN a_speeches p USING (document_id) LEFT JOIN a_speakers k ON k.speaker_id = p.speaker_id""",
}

ORACLES = {name: _sql(body) for name, body in _BODIES.items()}
