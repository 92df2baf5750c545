"""The SQL twin of each registered query, for DuckDB on the same tables."""

from __future__ import annotations

# --- views ------------------------------------------------------------------

ACTIVITY = """activity AS (
  SELECT user_id * 100 + day(ts) AS doc_id, event_id AS pos,
    'U' || (event_id % 3) AS unit_id, 'U' || (user_id % 3) AS unit_dispatched,
    CASE WHEN event_id % 7 = 0 THEN 'STAGED' WHEN event_type = 'view' THEN 'RESP'
      WHEN event_type = 'click' THEN 'ONLOC' WHEN event_type = 'signup' THEN 'TO HOSP'
      WHEN event_type = 'purchase' THEN 'AT HOSP' WHEN event_type = 'error' THEN 'CLEAR'
    END AS status,
    date_trunc('second', ts) AS ts
  FROM events)"""

FIELDS = [
    "notifiedByDispatch",
    "enRoute",
    "onScene",
    "arrivedAtPatient",
    "leftScene",
    "ptArrivedAtDestination",
    "destinationPatientTransferOfCare",
    "backInService",
]

MAPPED = f"""{ACTIVITY}, matched AS (SELECT * FROM activity WHERE unit_id = unit_dispatched),
mapped AS (
  SELECT *, CASE status WHEN 'RESP' THEN 'enRoute' WHEN 'ONLOC' THEN 'onScene'
    WHEN 'TO HOSP' THEN 'leftScene' WHEN 'AT HOSP' THEN 'ptArrivedAtDestination'
    WHEN 'CLEAR' THEN 'backInService' END AS field
  FROM matched WHERE status <> 'STAGED')"""

PIVOTED = f"""{MAPPED}, pivoted AS (
  SELECT doc_id, {", ".join(f"arg_min(ts, pos) FILTER (field = '{f}') AS {f}" for f in FIELDS)}
  FROM mapped GROUP BY doc_id)"""

DERIVED = f"""{PIVOTED}, derived AS (
  SELECT * REPLACE (
    coalesce(arrivedAtPatient, onScene + INTERVAL 2 MINUTE) AS arrivedAtPatient,
    coalesce(destinationPatientTransferOfCare, ptArrivedAtDestination + INTERVAL 5 MINUTE)
      AS destinationPatientTransferOfCare)
  FROM pivoted)"""

TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
ALL_TIMES = ", ".join(f"{TS.format(f)} AS {f}" for f in FIELDS)

# Page texts are never built here: what they say follows from the document number.
HEADERS = f"""{ACTIVITY}, docs AS (
  SELECT DISTINCT doc_id, unit_dispatched, doc_id // 100 AS u, doc_id % 100 AS d FROM activity),
headers AS (
  SELECT doc_id, u,
    CASE WHEN u % 11 <> 0 THEN doc_id::VARCHAR END AS cad,
    unit_dispatched,
    CASE WHEN u % 13 <> 0 THEN 'MEDICAL' END AS incident_type,
    CASE WHEN u % 17 = 0 THEN '02/30/2024 06:07:08'
      ELSE '01/' || lpad(d::VARCHAR, 2, '0') || '/2024 06:07:08' END AS notifiedByDispatch,
    CASE WHEN u % 19 = 0 THEN NULL WHEN u % 23 = 0 THEN 'EASTON TWP'
      ELSE 'EASTON TWP PLAZA / ' || u || ' MAIN ST #' || d END AS location_raw,
    CASE WHEN u % 5 = 0 THEN '01/' || lpad(d::VARCHAR, 2, '0') || '/2024 07:08:09' END
      AS arrivedAtPatient,
    NULL::VARCHAR AS destinationPatientTransferOfCare
  FROM docs)"""

RECORDS = """records AS (
  SELECT o_orderkey AS k, o_custkey AS customer, o_orderdate AS ordered,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'X' || o_orderkey
      WHEN o_orderkey % 5 = 0 THEN ' ' || o_orderkey || chr(12288) ELSE o_orderkey::VARCHAR END AS cad,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN ''
      ELSE 'U' || (o_orderkey % 4) END AS unit,
    CASE WHEN o_orderkey % 17 = 0 THEN '02/30/1998' WHEN o_orderkey % 19 = 0 THEN ''
      ELSE strftime(o_orderdate, '%m/%d/%Y') END AS date,
    '1:2:3' AS time,
    CASE WHEN o_orderkey % 29 = 0 THEN repeat(o_orderkey::VARCHAR, 60)
      ELSE 'EASTON TWP ' || o_orderkey || ' MAIN ST' END AS raw,
    repeat(o_orderpriority, 3) AS type
  FROM orders)"""

ERRORS = f"""{RECORDS}, checked AS (
  SELECT *, CASE
    WHEN coalesce(unit, '') = '' THEN 'Missing required field in PCR JSON: ''incidentTimes.unit_dispatched not found and unit_id not provided'''
    WHEN cad IS NULL THEN 'Missing required field in PCR JSON: ''incidentTimes.cad'''
    WHEN try_cast(trim(cad, ' ' || chr(12288)) AS BIGINT) IS NULL THEN 'Database operation failed: CAD number ''' || cad || ''' cannot be converted to integer'
    WHEN k % 23 = 0 THEN 'Database operation failed: ''NoneType'' object has no attribute ''get'''
    WHEN date = '' THEN 'Missing required field in PCR JSON: ''notifiedByDispatch.date or notifiedByDispatch.time'''
    WHEN try_strptime(date || ' ' || time, '%m/%d/%Y %H:%M:%S') IS NULL THEN 'Database operation failed: Failed to parse datetime ''' || date || ' ' || time || ''': day is out of range for month'
    END AS error
  FROM records)"""

INCIDENT_ROWS = """incident_rows AS (
  SELECT user_id AS incident_number, event_type AS unit_id, ts AS created_date,
    CASE WHEN event_id % 10 <> 0 THEN props END AS content, ts AS incident_date,
    CASE WHEN event_id % 9 <> 0 THEN 'L' || event_id END AS location,
    event_type AS incident_type, event_id AS place, day(ts) > 15 AS second_batch
  FROM events)"""

LOCATIONS = """locations AS (
  SELECT c_custkey AS k, n_name
    || CASE c_custkey % 3 WHEN 0 THEN ' TWP' WHEN 1 THEN ' BORO' ELSE '' END
    || CASE WHEN c_custkey % 4 = 0 THEN ' SITE & CO / ' ELSE ' ' END
    || c_custkey || ' MAIN ST'
    || CASE WHEN c_custkey % 7 = 0 THEN ' & OAK AVE' ELSE '' END
    || CASE WHEN c_custkey % 5 = 0 THEN ' #' || (c_custkey % 50) ELSE '' END AS raw
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
territories AS (
  SELECT k, raw, split_part(raw, ' ', 1)
    || CASE WHEN split_part(raw, ' ', 2) IN ('TWP', 'BORO') THEN ' ' || split_part(raw, ' ', 2)
       ELSE '' END AS territory
  FROM locations),
rests AS (SELECT *, trim(substr(raw, length(territory) + 1)) AS rest FROM territories),
addresses AS (
  SELECT *, CASE WHEN contains(rest, '/') THEN substr(rest, instr(rest, '/') + 1) ELSE rest END AS address,
    NOT contains(rest, '/') AND contains(rest, '&') AS crossing
  FROM rests),
segments AS (
  SELECT k, raw, territory,
    CASE WHEN contains(rest, '/') THEN nullif(trim(split_part(rest, '/', 1)), '') END AS location_name,
    nullif(trim(CASE WHEN crossing THEN address ELSE split_part(address, '#', 1) END), '')
      AS street_address,
    CASE WHEN NOT crossing AND contains(address, '#')
      THEN nullif(trim(substr(address, instr(address, '#') + 1)), '') END AS apartment
  FROM addresses)"""

RESPONSES = """responses AS (
  SELECT event_id AS doc_id,
    CASE WHEN event_id % 14 = 0 THEN '{"error":null}' WHEN event_id % 22 = 0 THEN '[1]'
      WHEN event_id % 10 = 0 THEN left(props, length(props) - 1)
      WHEN event_id % 26 = 0 THEN props || ' as asked' ELSE props END AS text,
    CASE WHEN event_id % 14 = 0 THEN 'error key' WHEN event_id % 22 = 0 THEN 'list'
      WHEN event_id % 10 = 0 OR event_id % 26 = 0 THEN 'broken' ELSE 'good' END AS kind,
    CASE WHEN event_id % 14 = 0 THEN 'None'
      WHEN event_id % 22 = 0 THEN 'API call failed: list indices must be integers or slices, not str'
      WHEN event_id % 10 = 0 OR event_id % 26 = 0
        THEN 'Failed to parse JSON response: the text is not one JSON value' END AS error
  FROM events)"""

MESSAGES = """messages AS (
  SELECT source AS mailbox, doc_id AS seq,
    CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 23 = 0 THEN '<' || (doc_id - 20) || '>'
      ELSE '<' || doc_id || '>' END AS message_id,
    text AS subject, lang || '.desk@example.org' AS sender, n_chars % 5 <> 0 AS seen
  FROM documents),
processed_ids AS (SELECT '<' || doc_id || '>' AS message_id FROM labels WHERE doc_id % 7 = 0)"""


def _reached(policy: str, subject: str = "subject", fails: str = "FALSE") -> str:
    match = f"contains(lower({subject}), 'the ')"
    stop = "in_state OR (message_id <> '' AND copy > 1)"
    if policy == "reference":
        stop += f" OR message_id = '' OR NOT {match} OR {fails}"
    return f"""{MESSAGES}, wanted AS (
  SELECT *, row_number() OVER (PARTITION BY mailbox ORDER BY seq DESC) AS rank
  FROM messages WHERE seen AND contains(lower(sender), 'en.desk@')),
newest AS (
  SELECT *, row_number() OVER (PARTITION BY mailbox, message_id ORDER BY seq DESC) AS copy,
    message_id IN (SELECT message_id FROM processed_ids) AS in_state, {match} AS match
  FROM wanted WHERE rank <= 15),
stops AS (
  SELECT mailbox, max(seq) AS stop_seq FROM newest WHERE {stop} GROUP BY mailbox),
reached AS (
  SELECT n.*, n.seq > coalesce(s.stop_seq, -1) AND message_id <> '' AND match AS processed
  FROM newest n LEFT JOIN stops s USING (mailbox) WHERE n.seq >= coalesce(s.stop_seq, -1))"""


PARTS = """parts AS (
  SELECT 'm' || (page_id % 3) AS mailbox, page_id AS seq, 0 AS part_no,
    ['application/pdf', 'application/octet-stream', 'text/plain', 'image/png',
     'application/octet-stream', 'application/x-page'][page_id % 6 + 1] AS content_type,
    ['ATTACHMENT; filename="x"', 'inline', NULL, 'form-data'][page_id % 4 + 1]
      AS content_disposition,
    CASE WHEN page_id % 9 = 0 THEN NULL
      WHEN page_id % 5 = 0 THEN regexp_extract(url, '[^/]*$') || '.PDF'
      ELSE regexp_extract(url, '[^/]*$') END AS filename,
    CASE WHEN page_id % 12 = 0 THEN '' ELSE html END AS payload
  FROM pages),
selected AS (
  SELECT * FROM parts
  WHERE content_type NOT IN ('text/plain', 'text/html')
    AND (content_disposition ILIKE '%attachment%' OR content_disposition ILIKE '%inline%'
      OR content_type IN ('application/pdf', 'application/octet-stream'))),
given AS (
  SELECT * REPLACE (CASE WHEN coalesce(filename, '') <> '' THEN filename
      WHEN content_type IN ('application/pdf', 'application/octet-stream')
        THEN 'fax_' || seq || '_20250102_030405_' || part_no || '.pdf' END AS filename)
  FROM selected),
named AS (
  SELECT * REPLACE (CASE WHEN lower(filename) LIKE '%.pdf' THEN filename
      ELSE filename || '.pdf' END AS filename)
  FROM given
  WHERE filename IS NOT NULL
    AND (lower(filename) LIKE '%.pdf' OR content_type = 'application/octet-stream'))"""

_UNIQUE = """CASE WHEN number = 1 THEN filename ELSE
    regexp_extract(filename, '^(.*)[.][^.]*$', 1) || '_20250102_030405_' || mailbox || '_' || seq
    || '_' || part_no || '.' || regexp_extract(filename, '[^.]*$') END"""

_UNKNOWN = "unknown encoding: no-such-charset"

# --- twins ------------------------------------------------------------------

_LINES = """SELECT line, count(*) AS n
      FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
      GROUP BY line"""

ORACLE: dict[str, str] = {
    "scan_documents": _LINES,
    "stream_documents": _LINES,
    "message_parts": f"""WITH {MESSAGES}
      SELECT mailbox, seq, message_id, 0::BIGINT AS part_no, 'text/plain' AS content_type,
        NULL::VARCHAR AS content_disposition, NULL::VARCHAR AS filename,
        md5(subject) AS payload_md5, NULL::VARCHAR AS error FROM messages
      UNION ALL SELECT mailbox, seq, message_id, 1, 'application/octet-stream',
        'ATTACHMENT; filename="fax"', 'fax', md5(subject), NULL FROM messages
      UNION ALL SELECT mailbox, seq, message_id, 2, 'application/octet-stream',
        'ATTACHMENT; filename="=?no-such-charset?q?x?="', NULL, NULL, '{_UNKNOWN}'
      FROM messages WHERE seq % 29 = 0""",
    "message_headers": f"""WITH {MESSAGES}
      SELECT mailbox, seq, seen, message_id, 'report the ' || seq AS subject,
        CASE WHEN seq % 37 = 0 THEN '=?no-such-charset?q?x?= <' || sender || '>' ELSE sender END
          AS sender,
        CASE WHEN seq % 37 = 0 THEN '{_UNKNOWN}' END AS error FROM messages""",
    "load_processed_ids": "SELECT DISTINCT '<' || doc_id || '>' AS message_id FROM labels",
    "append_processed_ids": f"""WITH {_reached("reference")}
      SELECT message_id FROM processed_ids
      UNION SELECT message_id FROM reached
      WHERE message_id <> '' AND (processed OR NOT match)""",
    "upsert_incidents": f"""WITH {INCIDENT_ROWS},
      ranked AS (SELECT *,
          row_number() OVER (PARTITION BY incident_number, unit_id
            ORDER BY second_batch DESC, place DESC) AS rn,
          first_value(created_date) OVER (PARTITION BY incident_number, unit_id
            ORDER BY second_batch, place) AS created
        FROM incident_rows)
      SELECT incident_number, unit_id, {TS.format("created")} AS created_date, content,
        {TS.format("incident_date")} AS incident_date, location, incident_type
      FROM ranked WHERE rn = 1""",
    "quarantine_errors": f"""WITH {RESPONSES}
      SELECT doc_id, 'd.o' || doc_id || '_20250102_030405.pdf' AS error_file,
        'd.o' || doc_id || '.pdf' AS original_file, '2025-01-02 03:04:05' AS error_at, error
      FROM responses WHERE kind <> 'good'""",
    "filter_sender_seen": f"""WITH {MESSAGES} SELECT mailbox, seq, message_id FROM messages
      WHERE seen AND contains(lower(sender), 'en.desk@')""",
    "newest_n_messages": f"""WITH {MESSAGES} SELECT mailbox, seq, message_id FROM messages
      QUALIFY row_number() OVER (PARTITION BY mailbox ORDER BY seq DESC) <= 15""",
    "subject_match": f"""WITH {MESSAGES} SELECT mailbox, seq, message_id FROM messages
      WHERE contains(lower(subject), 'the ')""",
    "anti_join_processed": f"""WITH {MESSAGES} SELECT mailbox, seq, message_id FROM messages
      WHERE message_id NOT IN (SELECT message_id FROM processed_ids)""",
    "take_until_stop": f"""WITH {_reached("reference")}
      SELECT mailbox, seq, message_id, processed FROM reached""",
    "take_until_stop_seen_only": f"""WITH {_reached("seen_only")}
      SELECT mailbox, seq, message_id, processed FROM reached""",
    "poll_stats": f"""WITH {_reached("reference")}
      SELECT mailbox, count(reached.seq) AS emails_checked,
        count(*) FILTER (processed) AS emails_processed
      FROM (SELECT DISTINCT mailbox FROM messages) LEFT JOIN reached USING (mailbox)
      GROUP BY mailbox""",
    # A stop row that has nothing against it but its second attachment keeps the first one.
    "poll_round": f"""WITH {_reached("reference", "'report the '", "seq % 29 = 0 OR seq % 37 = 0")},
      named AS (SELECT mailbox, seq, 1 AS part_no, 'fax.pdf' AS filename, subject, 2 AS number
        FROM reached WHERE length(subject) > 0 AND (processed OR (seq % 29 = 0 AND seq % 37 <> 0
          AND message_id <> '' AND copy = 1 AND NOT in_state)))
      SELECT mailbox, seq, {_UNIQUE} AS filename, md5(subject) AS payload_md5 FROM named""",
    "stream_dedup_messages": """SELECT DISTINCT user_id || '-' || event_type AS message_id
      FROM events""",
    "select_attachments": f"""WITH {PARTS}
      SELECT mailbox, seq, filename, content_type, content_disposition FROM selected""",
    "attachment_filenames": f"WITH {PARTS} SELECT mailbox, seq, filename FROM named",
    "drop_empty_payloads": f"""WITH {PARTS}
      SELECT mailbox, seq, strlen(payload)::BIGINT AS n_bytes FROM parts WHERE strlen(payload) > 0""",
    "dedupe_filenames": f"""WITH {PARTS},
      held AS (SELECT DISTINCT filename FROM named WHERE mailbox = 'm0' AND seq % 2 = 0),
      numbered AS (SELECT mailbox, seq, part_no, n.filename,
          row_number() OVER (PARTITION BY n.filename ORDER BY mailbox, seq DESC, part_no)
            + (h.filename IS NOT NULL)::INT AS number
        FROM named n LEFT JOIN held h ON n.filename = h.filename
        WHERE NOT (mailbox = 'm0' AND seq % 2 = 0))
      SELECT mailbox, seq, {_UNIQUE} AS filename FROM numbered""",
    "daypart": """SELECT CASE WHEN hour(ts) >= 23 OR hour(ts) < 6 THEN 'night' ELSE 'day' END
        AS daypart, count(*) AS n FROM events GROUP BY 1""",
    "assemble_pages": """SELECT conv_id AS doc_id, turn // 1000 AS part_no,
        sum(count(*)) OVER (PARTITION BY conv_id)::BIGINT AS n_pages,
        string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1, 2""",
    "page_text": """SELECT conv_id AS doc_id, turn AS page_no, text FROM conversations
      WHERE turn = 1""",
    "extract_header_fields": f"WITH {HEADERS} SELECT * EXCLUDE (u) FROM headers",
    "activity_rows": f"""WITH {ACTIVITY}
      SELECT doc_id, (pos // 1000) * 4294967296
          + row_number() OVER (PARTITION BY doc_id, pos // 1000 ORDER BY pos) - 1 AS pos,
        unit_id, {TS.format("ts")} AS ts, status FROM activity""",
    "match_dispatched_unit": f"""WITH {MAPPED}
      SELECT doc_id, unit_id, pos, status, {TS.format("ts")} AS ts FROM matched""",
    "map_status": f"""WITH {ACTIVITY.replace("activity AS", "matched AS")}, {
        MAPPED.split("= unit_dispatched),", 1)[1]}
      SELECT doc_id, pos, status, field FROM mapped""",
    "first_occurrence": f"""WITH {MAPPED}
      SELECT doc_id, field, {TS.format("arg_max(ts, pos)")} AS ts FROM mapped
      GROUP BY doc_id, field""",
    "pivot_times": f"WITH {PIVOTED} SELECT doc_id, {ALL_TIMES} FROM pivoted",
    "derived_times": f"WITH {DERIVED} SELECT doc_id, {ALL_TIMES} FROM derived",
    "split_datetime": """SELECT event_id, strftime(ts, '%m/%d/%Y') AS date,
        strftime(ts, '%H:%M:%S') AS time FROM events""",
    "location_territory": f"WITH {LOCATIONS} SELECT k, territory FROM segments",
    "location_segments": f"""WITH {LOCATIONS}
      SELECT k, location_name, street_address, apartment FROM segments""",
    "parsing_errors": f"""WITH {HEADERS},
      problems AS (
        SELECT doc_id, 'cad' AS field, 'not found in document' AS error FROM headers
          WHERE cad IS NULL
        UNION ALL SELECT doc_id, 'incident_type', 'not found in document' FROM headers
          WHERE incident_type IS NULL
        UNION ALL SELECT doc_id, 'incidentLocation.raw', 'not found in document' FROM headers
          WHERE location_raw IS NULL
        UNION ALL SELECT doc_id, 'notifiedByDispatch',
            'not a valid mm/dd/yyyy hh:mm:ss date and time' FROM headers WHERE u % 17 = 0
        UNION ALL SELECT doc_id, 'incidentLocation', 'no street address in location text'
          FROM headers WHERE location_raw = 'EASTON TWP')
      SELECT * FROM problems""",
    "unparseable_documents": """SELECT doc_id,
        '{"error":"no incident field could be extracted from the document"}' AS content
      FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 11 = 0""",
    "strip_code_fences": f"WITH {RESPONSES} SELECT doc_id, text FROM responses",
    "parse_response": f"""WITH {RESPONSES}
      SELECT doc_id,
        CASE WHEN kind = 'good' THEN regexp_extract(text, '[0-9]+')::BIGINT END AS k,
        CASE WHEN kind <> 'error key' THEN error END AS error,
        CASE WHEN kind = 'broken' THEN text END AS raw_response FROM responses""",
    "route_errors": f"""WITH {RESPONSES}
      SELECT doc_id, CASE WHEN kind = 'good' THEN 'good' ELSE 'bad' END AS route
      FROM responses""",
    "token_usage": f"""WITH {RESPONSES}
      SELECT doc_id, left(text, length(text) - 1) || ',"_token_usage":{{"prompt_tokens":' || doc_id
        || ',"completion_tokens":' || (doc_id % 100)
        || ',"total_tokens":' || (doc_id + doc_id % 100) || '}}}}' AS content,
        CASE WHEN kind = 'good' THEN regexp_extract(text, '[0-9]+') END AS stored_k,
        FALSE AS stored_usage
      FROM responses WHERE kind IN ('good', 'error key')""",
    "resolve_unit_id": f"""WITH {RECORDS}
      SELECT k, nullif(unit, '') AS dispatched,
        CASE WHEN k % 3 = 0 THEN '' WHEN k % 4 = 0 THEN 'GIVEN' ELSE nullif(unit, '') END
          AS resolved FROM records""",
    "cast_cad": f"""WITH {RECORDS}
      SELECT k, try_cast(trim(cad, ' ' || chr(12288)) AS BIGINT) AS incident_number FROM records""",
    "parse_incident_date": f"""WITH {RECORDS}
      SELECT k, {TS.format("try_strptime(date || ' ' || time, '%m/%d/%Y %H:%M:%S')")}
        AS incident_date FROM records""",
    "bound_text": f"""WITH {RECORDS}
      SELECT k, left(raw, 300) AS location, left(type, 20) AS incident_type FROM records""",
    "serialize_content": f"""WITH {RESPONSES}
      SELECT doc_id, text AS content FROM responses WHERE kind = 'good'""",
    "validate_record": f"WITH {ERRORS} SELECT k, error FROM checked",
    "outcome_rows": f"""WITH {ERRORS}
      SELECT k::VARCHAR AS doc_id, error IS NULL AS success,
        CASE WHEN error IS NULL THEN trim(cad, ' ' || chr(12288))::BIGINT END AS incident_number,
        CASE WHEN error IS NULL THEN unit END AS unit_id,
        'Database save failed: ' || error AS error FROM checked""",
    "enforce_constraints": f"""WITH {INCIDENT_ROWS}
      SELECT place, CASE WHEN content IS NULL THEN 'content' END AS violated
      FROM incident_rows""",
    "key_violations": f"""WITH {INCIDENT_ROWS}
      SELECT incident_number, unit_id, count(*) AS n FROM incident_rows
      GROUP BY 1, 2 HAVING count(*) > 1""",
    "incident_timeline": f"""WITH {DERIVED}, steps AS ({
        " UNION ALL ".join(
            f"SELECT doc_id, {i} AS i, '{f}' AS event, {f} AS ts FROM derived WHERE {f} IS NOT NULL"
            for i, f in enumerate(FIELDS))})
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ordinal, event,
        strftime(ts, '%m/%d/%Y') AS date, strftime(ts, '%H:%M:%S') AS time FROM steps""",
    "incident_summary": f"""WITH {LOCATIONS}
      SELECT k, CASE WHEN k % 6 <> 0 THEN k::VARCHAR ELSE 'N/A' END AS cad,
        CASE WHEN k % 11 <> 0 THEN raw ELSE 'N/A' END AS location,
        {", ".join(f"CASE WHEN k % 11 <> 0 THEN {c} END AS {c}" for c in
            ("territory", "location_name", "street_address", "apartment"))}
      FROM segments""",
    "ingest_pipeline": f"""WITH {ERRORS.replace("try_cast(trim(cad, ' ' || chr(12288)) AS BIGINT) IS NULL", "FALSE")
        .replace("WHEN cad IS NULL", "WHEN FALSE")}
      SELECT customer AS incident_number, unit AS unit_id, '2025-01-02 03:04:05' AS created_date,
        {TS.format("strptime(date || ' ' || time, '%m/%d/%Y %H:%M:%S')")} AS incident_date,
        left(raw, 300) AS location, left(type, 20) AS incident_type
      FROM checked WHERE error IS NULL
      QUALIFY row_number() OVER (PARTITION BY customer, unit
        ORDER BY ordered DESC, k::VARCHAR DESC) = 1""",
    "prepared_records": f"""WITH {RESPONSES}, {ERRORS}
      SELECT FALSE AS success, coalesce(error, 'Database save failed: Missing required field in PCR JSON: ''incidentTimes.unit_dispatched not found and unit_id not provided''') AS error,
        NULL AS incident_type, count(*) AS n, NULL::BIGINT AS numbers FROM responses GROUP BY 1, 2
      UNION ALL
      SELECT error IS NULL, 'Database save failed: ' || error, left(type, 20), count(*),
        sum(try_cast(trim(cad, ' ' || chr(12288)) AS BIGINT))::BIGINT FROM checked GROUP BY 1, 2, 3""",
}

# Incident JSON of the dispatch pages, key by key; null parts are left out.


def _clock(value: str) -> str:
    return (
        f"""'{{"date":"' || strftime({value}, '%m/%d/%Y') || '","time":"' """
        f"""|| strftime({value}, '%H:%M:%S') || '"}}'"""
    )


def _member(name: str, value: str) -> str:
    return f"""'"{name}":' || {value}"""


def _text(column: str) -> str:
    return f"""'"' || {column} || '"'"""


def _object(members: list[str]) -> str:
    return f"""'{{' || concat_ws(',', {", ".join(members)}) || '}}'"""


def _problem(field: str, error: str, holds: str) -> str:
    return f"""CASE WHEN {holds} THEN '{{"field":"{field}","error":"{error}"}}' END"""


_NOT_FOUND = "not found in document"
_PROBLEMS = [
    _problem("cad", _NOT_FOUND, "cad IS NULL"),
    _problem("incident_type", _NOT_FOUND, "incident_type IS NULL"),
    _problem("incidentLocation.raw", _NOT_FOUND, "location_raw IS NULL"),
    _problem(
        "notifiedByDispatch", "not a valid mm/dd/yyyy hh:mm:ss date and time", "u % 17 = 0"
    ),
    _problem(
        "incidentLocation", "no street address in location text", "location_raw = 'EASTON TWP'"
    ),
]

ORACLE["build_incident_json"] = f"""WITH {DERIVED}, {HEADERS.split(ACTIVITY + ", ", 1)[1]},
  joined AS (
    SELECT h.doc_id, h.u, h.cad, h.unit_dispatched, h.incident_type, h.location_raw,
      try_strptime(h.notifiedByDispatch, '%m/%d/%Y %H:%M:%S') AS notifiedByDispatch,
      coalesce(try_strptime(h.arrivedAtPatient, '%m/%d/%Y %H:%M:%S'), t.arrivedAtPatient)
        AS arrivedAtPatient,
      {", ".join(f"t.{f}" for f in FIELDS[1:] if f != "arrivedAtPatient")}
    FROM headers h LEFT JOIN derived t USING (doc_id)),
  pieces AS (
    SELECT *,
      {_object([_member(f, _clock(f)) for f in FIELDS])} AS times,
      CASE WHEN location_raw IS NULL THEN NULL WHEN location_raw = 'EASTON TWP'
        THEN {_object([_member("raw", _text("location_raw")),
                       _member("territory", "'\"EASTON TWP\"'")])}
        ELSE {_object([_member("raw", _text("location_raw")),
                       _member("territory", "'\"EASTON TWP\"'"),
                       _member("location_name", "'\"PLAZA\"'"),
                       _member("street_address", _text("u || ' MAIN ST'")),
                       _member("apartment", _text("(doc_id % 100)"))])} END AS place,
      concat_ws(',', {", ".join(_PROBLEMS)}) AS problems
    FROM joined)
  SELECT doc_id, {_object([
      _member("incidentTimes", _object([
          _member("cad", _text("cad")),
          _member("unit_dispatched", _text("unit_dispatched")),
          _member("incident_type", _text("incident_type")),
          _member("times", "nullif(times, '{}')"),
      ])),
      _member("incidentLocation", "place"),
      _member("parsingErrors", "('[' || nullif(problems, '') || ']')"),
  ])} AS content
  FROM pieces"""

ORACLE["upsert_partitions"] = ORACLE["upsert_incidents"]
ORACLE["anti_join_filtered"] = ORACLE["anti_join_processed"]
ORACLE["seen_set_generations"] = ORACLE["load_processed_ids"]

ORACLE["stream_dedup_seeded"] = """SELECT DISTINCT user_id || '-' || event_type AS message_id
  FROM events WHERE user_id % 5 <> 0"""

# Files by document number; a text takes its bytes and a line feed.
ORACLE["ingest_documents"] = """WITH texts AS (
    SELECT coalesce(doc_id, 0) AS doc_id, coalesce(text, '') AS text FROM documents),
  filed AS (SELECT *, doc_id % (SELECT greatest(1, ceil(sum(strlen(text)) / 262144.0))::BIGINT FROM texts) AS file
    FROM texts),
  sizes AS (SELECT file, sum(strlen(text) + 1) AS bytes FROM filed GROUP BY file)
  SELECT 'read' AS kind, line, count(*) AS n
  FROM (SELECT unnest(string_split(text, chr(10))) AS line
    FROM filed JOIN sizes USING (file) WHERE bytes <= 262144) GROUP BY line
  UNION ALL SELECT 'too long', NULL, count(*) FROM sizes WHERE bytes > 262144"""

# Messages are reached as in one round, as mailboxes do not share IDs; only the first holder of the
# first round keeps the plain name.
ORACLE["mail_rounds"] = f"""WITH {_reached("reference", "'report the '", "seq % 29 = 0 OR seq % 37 = 0")},
  rounds AS (SELECT *, ('0x' || substr(md5(mailbox), 1, 1))::INT % 2 AS round_no FROM reached),
  saved AS (SELECT mailbox, seq, 1 AS part_no, 'fax.pdf' AS filename, subject, round_no
    FROM rounds WHERE length(subject) > 0 AND (processed OR (seq % 29 = 0 AND seq % 37 <> 0
      AND message_id <> '' AND copy = 1 AND NOT in_state))),
  named AS (SELECT *, CASE WHEN round_no = 0 THEN row_number() OVER (PARTITION BY round_no ORDER BY mailbox, seq DESC)
    ELSE 2 END AS number FROM saved)
  SELECT {_UNIQUE} AS filename, md5(subject) AS payload_md5, strlen(subject)::BIGINT AS length, round_no FROM named"""

# Which pages came follows from the document number; a document with all of them is stored if it has a
# number and its clock exists.
ORACLE["ingest_pages"] = f"""WITH built AS ({ORACLE["build_incident_json"]}), {ACTIVITY},
  counts AS (SELECT doc_id, count(*) FILTER (pos // 1000 % 2 = 1) AS odd, count(*) FILTER (pos // 1000 % 2 = 0) AS even
    FROM activity GROUP BY doc_id),
  known AS (SELECT *, (doc_id // 100) % 11 <> 0 AND (doc_id // 100) % 17 <> 0 AS good FROM built JOIN counts USING (doc_id))
  SELECT doc_id, CASE WHEN good THEN 'stored' ELSE 'rejected' END AS kind, CASE WHEN good THEN content END AS content
  FROM known WHERE doc_id % 21 <> 0 OR odd = 0 OR doc_id % 5 = 0
  UNION ALL SELECT doc_id, 'incomplete', NULL FROM known WHERE doc_id % 21 = 0 AND odd > 0 AND even > 0"""
