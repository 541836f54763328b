"""Scalar functions and text preparation."""

from pyspark.sql import functions as F

from runlens.functions import nested, numbers, timefmt
from runlens.functions import text as tx

from .registry import check

SEC = "CAST(floor(value * 100000) AS BIGINT)"
C = F.col


def seconds():
    return F.floor(F.col("value") * 100000)


@check("C1_case", "SELECT id, upper(status) AS up, lower(job_name) AS low FROM runs")
def _(t):
    return t.runs.select("id", F.upper("status").alias("up"), F.lower("job_name").alias("low"))


@check("C2_month", "SELECT id, CAST(month(last_activity) AS INT) AS m, monthname(last_activity) AS name FROM runs_o")
def _(t):
    ts = C("last_activity")
    return t.runs_o.select("id", timefmt.month_no(ts).alias("m"), timefmt.month_name(ts).alias("name"))


@check("C3_interval", "SELECT id, last_activity - INTERVAL 30 DAY AS before FROM runs")
def _(t):
    return t.runs.select("id", (C("last_activity") - timefmt.days(30)).alias("before"))


@check("C4_day", "SELECT id, CAST(createdDtm AS DATE) AS day FROM logins")
def _(t):
    return t.logins.select("id", timefmt.day_of(C("createdDtm")).alias("day"))


@check("C5_day_bounds", """
SELECT id, date_trunc('day', last_activity)::TIMESTAMP AS first,
  date_trunc('day', last_activity)::TIMESTAMP + INTERVAL '23:59:59' HOUR TO SECOND AS last FROM runs
""".replace("INTERVAL '23:59:59' HOUR TO SECOND", "to_seconds(86399)"))
def _(t):
    text = F.date_format("last_activity", "dd-MM-yyyy")
    return t.runs.select("id", timefmt.day_start(text).alias("first"), timefmt.day_end(text).alias("last"))


_ORD = """CAST(day(last_activity) AS VARCHAR) || CASE WHEN day(last_activity) IN (11, 12, 13) THEN 'th'
  WHEN day(last_activity) % 10 = 1 THEN 'st' WHEN day(last_activity) % 10 = 2 THEN 'nd'
  WHEN day(last_activity) % 10 = 3 THEN 'rd' ELSE 'th' END"""


@check("C6_formats", f"""
SELECT id, strftime(last_activity, '%m-%d-%Y %H:%M:%S') AS short,
  strftime(last_activity, '%A, %B ') || {_ORD} || strftime(last_activity, ' %Y') AS long,
  strftime(last_activity, '%B ') || {_ORD} || strftime(last_activity, ' %Y, %-I:%M:%S ') || lower(strftime(last_activity, '%p')) AS moment
FROM runs
""")
def _(t):
    return t.runs.select("id", *[timefmt.fmt_ts(C("last_activity"), s).alias(s) for s in ("short", "long", "moment")])


@check("C7_running", """
SELECT id, id % 5000 AS seconds, printf('%d days, %02d hours, %02d minutes, %02d seconds',
  CAST(floor((id % 5000) / 86400) AS BIGINT), CAST(floor((id % 5000) / 3600) AS BIGINT),
  CAST(floor((id % 5000) % 3600 / 60) AS BIGINT), (id % 5000) % 60) AS text FROM runs
""")
def _(t):
    a, b = C("start_time"), C("last_activity")
    return t.runs.select("id", timefmt.running_seconds(a, b).alias("seconds"), timefmt.running_text(a, b).alias("text"))


_MS = "printf('%02d Hours,  %02d Minutes,  %02d Seconds,  %03d Miliseconds.', {ms} // 3600000, {ms} % 3600000 // 60000, {ms} % 60000 // 1000, {ms} % 1000)"


@check("C8_build_times", f"""
SELECT number, make_timestamp(timestamp * 1000) AS started, {_MS.format(ms='(duration % 86400000)')} AS wrapped,
  {_MS.format(ms='duration')} AS total FROM builds
""")
def _(t):
    d = C("duration")
    return t.builds.select(
        "number", timefmt.ms_to_ts(C("timestamp")).alias("started"), timefmt.ms_text(d).alias("wrapped"),
        timefmt.ms_text(d, wrap=False).alias("total"),
    )


def _units(units, sec):
    """SQL text of one piece per unit; NULL when its count is 0."""
    rest, out = sec, []
    for name, size in units:
        n = f"(({rest}) // {size})"
        out.append(f"CASE WHEN {n} > 0 THEN {n} || CASE WHEN {n} = 1 THEN ' {name}' ELSE ' {name}s' END END")
        rest = f"({rest}) % {size}"
    return out


_UP = _units(timefmt.UPTIME_UNITS, "s")
_SPAN = _units(timefmt.TIMESPAN_UNITS, "greatest(s, 1)")


@check("C9_human_time", f"""
SELECT event_id, CASE WHEN len(p) > 1 THEN array_to_string(p[1:len(p)-1], ', ') || ' and ' || p[len(p)] ELSE p[1] END AS text
FROM (SELECT event_id, list_filter([{', '.join(_UP)}], lambda x: x IS NOT NULL) AS p
  FROM (SELECT event_id, {SEC} AS s FROM events))
""")
def _(t):
    return t.events.select("event_id", timefmt.human_time(seconds()).alias("text"))


@check("C10_timespan", f"""
SELECT event_id, CASE WHEN len(p) > 0 THEN array_to_string(p, ', ') ELSE greatest(s, 1) || CASE WHEN s > 1 THEN ' Seconds' ELSE ' Second' END END AS text,
  CASE WHEN len(p) > 0 THEN array_to_string(p[1:2], ', ') ELSE greatest(s, 1) || CASE WHEN s > 1 THEN ' Seconds' ELSE ' Second' END END AS two
FROM (SELECT event_id, s, list_filter([{', '.join(_SPAN)}], lambda x: x IS NOT NULL) AS p
  FROM (SELECT event_id, CAST(floor(value * value * 100) AS BIGINT) - 3 AS s FROM events))
""")
def _(t):
    s = F.floor(C("value") * C("value") * 100) - 3
    return t.events.select("event_id", timefmt.timespan(s).alias("text"), timefmt.timespan(s, 2).alias("two"))


_BYTES = "CAST(floor(value * value * value * 1000) AS BIGINT)"


def _plain(x):
    return f"regexp_replace(CAST(CAST(round({x}, 2) AS DECIMAL(24, 2)) AS VARCHAR), '\\.?0+$', '')"


@check("C11_sizes", f"""
SELECT event_id,
  CASE WHEN b > 1073741824 THEN {_plain('b / 1073741824.0::DOUBLE')} || ' GB' WHEN b > 1048576 THEN {_plain('b / 1048576.0::DOUBLE')} || ' MB'
    WHEN b > 1024 THEN {_plain('b / 1024.0::DOUBLE')} || ' KB' ELSE {_plain('b::DOUBLE')} || ' B' END AS size,
  CASE WHEN b >= 1000000000 THEN printf('%.1f', round(b / 1073741824.0::DOUBLE, 1)) || ' GB'
    WHEN b >= 1000000 THEN printf('%.1f', round(b / 1048576.0::DOUBLE, 1)) || ' MB'
    WHEN b >= 1000 THEN printf('%.1f', round(b / 1024.0::DOUBLE, 1)) || ' KB' ELSE b || ' Bytes' END AS bytes
FROM (SELECT event_id, {_BYTES} AS b FROM events)
""")
def _(t):
    n = F.floor(C("value") * C("value") * C("value") * 1000)
    return t.events.select("event_id", numbers.human_size(n).alias("size"), numbers.byte_format(n).alias("bytes"))


@check("C12_date_spine", """
SELECT CAST(d AS DATE) AS day, count(o.o_orderkey) AS orders FROM (
  SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders) s
LEFT JOIN orders o ON CAST(o.o_orderdate AS DATE) = CAST(d AS DATE) GROUP BY 1
""")
def _(t):
    span = t.orders.agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    days = span.select(timefmt.date_spine(C("a"), C("b")).alias("day"))
    per_day = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("orders"))
    return days.join(per_day, "day", "left").select("day", F.coalesce("orders", F.lit(0)).alias("orders"))


@check("C13_days_in_month", "SELECT o_orderkey, CAST(day(last_day(o_orderdate)) AS INT) AS n FROM orders")
def _(t):
    return t.orders.select("o_orderkey", timefmt.days_in_month(C("o_orderdate")).alias("n"))


@check("C14_parse_date", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(date_trunc('month', o_orderdate) AS DATE)
  WHEN 1 THEN CAST(date_trunc('month', o_orderdate) AS DATE) WHEN 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders
""")
def _(t):
    k, d = C("o_orderkey") % 6, C("o_orderdate")
    text = (
        F.when(k == 0, F.date_format(d, "yyyyMM")).when(k == 1, F.date_format(d, "MMyyyy"))
        .when(k == 2, F.date_format(d, "yyyyMMdd")).when(k == 3, F.date_format(d, "M-d-yyyy"))
        .when(k == 4, F.date_format(d, "yyyy-MM-dd")).otherwise(F.concat(F.lit("no date "), F.col("o_orderstatus")))
    )
    return t.orders.select("o_orderkey", timefmt.parse_date(text).alias("day"))


@check("C15_to_epoch", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events")
def _(t):
    return t.events.select("event_id", timefmt.to_epoch(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("s"))


@check("C16_lists", """
SELECT id, len(string_split(groups, ',')) AS n, array_to_string(list_reverse(string_split(groups, ',')), ',') AS turned,
  contains(groups, 'NATION_2') AS has_two FROM reports
""")
def _(t):
    parts = tx.split_list(C("groups"))
    return t.reports.select(
        "id", F.size(parts).cast("bigint").alias("n"), tx.join_list(F.reverse(parts)).alias("turned"),
        C("groups").contains("NATION_2").alias("has_two"),
    )


@check("C17_clean", """
SELECT p_partkey, array_to_string(list_transform(string_split(lower(trim(p_name)), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name,
  lower(trim(' ' || p_brand || '@X.com ')) AS email FROM part
""")
def _(t):
    mail = F.concat(F.lit(" "), C("p_brand"), F.lit("@X.com "))
    return t.part.select(
        "p_partkey", tx.clean_name(F.upper("p_name")).alias("name"), tx.clean_email(mail).alias("email")
    )


@check("C18_percent", """
SELECT o_orderkey, CAST(CASE WHEN o_custkey > 0 THEN 100 - floor((o_orderkey % (o_custkey + 1)) / CAST(o_custkey AS DOUBLE) * 100 + 0.5) ELSE 0 END AS BIGINT) AS used,
  least(CAST(trunc(o_totalprice / 1000 * 100 / 8) AS BIGINT), 100) AS load FROM orders
""")
def _(t):
    return t.orders.select(
        "o_orderkey",
        numbers.percent_used(C("o_orderkey") % (C("o_custkey") + 1), C("o_custkey")).alias("used"),
        numbers.load_pct(C("o_totalprice") / 1000, F.lit(8)).alias("load"),
    )


@check("C19_json", "SELECT id, json_extract_string(sessionData, '$.role') AS role, json_extract_string(sessionData, '$.name') AS name, sessionData AS again FROM logins")
def _(t):
    row = nested.json_to_row(C("sessionData"), "role string, name string")
    return t.logins.withColumn("_r", row).select(
        "id", "_r.role", "_r.name", nested.row_to_json("_r.role", "_r.name").alias("again")
    )


@check("C20_pluck", """
SELECT job, number // 64 AS page, array_to_string(list(result ORDER BY number), ',') AS results, arg_min(result, number) AS first FROM builds GROUP BY 1, 2
""")
def _(t):
    docs = build_pages(t)
    return docs.select(
        "job", "page", F.array_join(nested.pluck(C("builds"), "result"), ",").alias("results"),
        nested.first_of(C("builds"), "result").alias("first"),
    )


def build_pages(t):
    """Builds in pages of at most 64, ordered by number."""
    return t.builds.groupBy("job", F.floor(F.col("number") / 64).alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("number", "result"))).alias("builds")
    )


@check("C21_to_int", "SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, TRY_CAST(NULL AS BIGINT) AS none FROM events")
def _(t):
    tail = F.regexp_replace("props", r"^\D*", " ")
    return t.events.select("event_id", tx.to_int(tail).alias("k"), tx.to_int(C("event_type")).alias("none"))


@check("C22_ends", "SELECT job, number // 64 AS page, min(number) AS first, max(number) AS last FROM builds GROUP BY 1, 2")
def _(t):
    numbers_ = nested.pluck(C("builds"), "number")
    return build_pages(t).select(
        "job", "page", nested.first_el(numbers_).alias("first"), nested.last_el(numbers_).alias("last")
    )


@check("C23_cron", """
SELECT event_id, CASE WHEN m <> 0 THEN 'H/' || m END AS minute, CASE WHEN m <> 0 THEN CAST(user_id % 24 AS VARCHAR) END AS hour,
  CASE WHEN m <> 0 THEN '*' END AS day_of_month, CASE WHEN m <> 0 THEN '*' END AS month, CASE WHEN m <> 0 THEN '1-5' END AS day_of_week,
  CASE WHEN m = 0 THEN '@daily' END AS tag FROM (SELECT *, event_id % 60 AS m FROM events)
""")
def _(t):
    m = C("event_id") % 60
    spec = F.concat(F.lit("H/"), m.cast("string"), F.lit(" "), (C("user_id") % 24).cast("string"), F.lit(" * * 1-5"))
    return t.events.select("event_id", timefmt.cron_fields(F.when(m == 0, "@daily").otherwise(spec)).alias("c")).select("event_id", "c.*")


@check("C24_maps", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, -1 AS missing, CAST(json_extract(props, '$.k') AS INT) - 1 AS total FROM events
""")
def _(t):
    m = F.from_json("props", "map<string, int>")
    part = nested.map_subset(m, ["k", "z"], -1)
    total = F.aggregate(F.map_values(part), F.lit(0), lambda a, x: a + x)
    return t.events.select(
        "event_id", nested.map_get(m, "k").alias("k"), nested.map_get(m, "z", -1).alias("missing"), total.alias("total")
    )


@check("C25_instance_id", "SELECT count(*) AS n, count(*) AS well_formed, count(*) AS far_apart FROM runs")
def _(t):
    ids = t.runs.select(nested.instance_id().alias("short"), nested.instance_id(20).alias("long"))
    return ids.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("short").rlike("^[A-Z]{8}$")).alias("well_formed"),
        F.count_distinct("long").alias("far_apart"),
    )


# ---------------------------------------------------------------- text preparation

_BORDER = r"""[-_''"`(){}<>\[\]|!?@#%&,.:;^~*+=/ 0-9\n\r\t]"""


def _sql_censor(expr, word, new):
    return f"regexp_replace({expr}, '({_BORDER})({word})({_BORDER})', '\\1{new}\\3', 'gi')"


def _sql_trim(expr):
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


@check("V7_word_limit", """
SELECT doc_id, CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN text ELSE
  regexp_replace(regexp_extract(text, '^\\s*(?:\\S+\\s*){1,25}'), '\\s+$', '')
  || CASE WHEN length(regexp_extract(text, '^\\s*(?:\\S+\\s*){1,25}')) < length(text) THEN '&#8230;' ELSE '' END END AS text FROM documents
""")
def _(t):
    return t.documents.select("doc_id", tx.word_limit(C("text"), 25).alias("text"))


@check("V7_char_limit", """
SELECT doc_id, CASE WHEN length(text) < 200 THEN text WHEN length(f) <= 200 THEN f ELSE
  CASE WHEN length(o) = length(f) THEN o ELSE o || '&#8230;' END END AS text
FROM (SELECT *, CASE WHEN instr(b[200:], ' ') > 0 THEN b[1:199 + instr(b[200:], ' ') - 1] ELSE b END AS o
  FROM (SELECT *, trim(f) AS b FROM (
    SELECT doc_id, text, regexp_replace(regexp_replace(text, '[\\r\\n\\t\\v\\f]', ' ', 'g'), ' {2,}', ' ', 'g') AS f FROM documents)))
""")
def _(t):
    return t.documents.select("doc_id", tx.char_limit(C("text"), 200).alias("text"))


@check("V7_ellipsize", f"""
SELECT doc_id, CASE WHEN length(s) <= 120 THEN s ELSE s[1:120] || '&hellip;' END AS at_end,
  CASE WHEN length(s) <= 120 THEN s ELSE s[1:60] || '...' || right(s, 60) END AS middle
FROM (SELECT doc_id, {_sql_trim("regexp_replace(text, '<([^\\s>][^>]*)?>', '', 'g')")} AS s FROM documents)
""")
def _(t):
    return t.documents.select(
        "doc_id", tx.ellipsize(C("text"), 120).alias("at_end"), tx.ellipsize(C("text"), 120, 0.5, "...").alias("middle")
    )


@check("V7_censor", f"""
SELECT doc_id, {_sql_trim(_sql_censor(_sql_censor("' ' || text || ' '", 'the', '###'), 'que', '###'))} AS masked,
  {_sql_trim(_sql_censor("' ' || text || ' '", 'the', '[x]'))} AS replaced FROM documents
""")
def _(t):
    return t.documents.select(
        "doc_id", tx.censor_words(C("text"), ["the", "que"]).alias("masked"),
        tx.censor_words(C("text"), ["the"], "[x]").alias("replaced"),
    )


_APART = f"regexp_replace(' ' || text || ' ', '({_BORDER})(tion\\w*?)({_BORDER})', '\\1' || chr(65535) || '\\2' || chr(65535) || '\\3', 'gi')"
_HIDDEN = f"array_to_string(list_transform(string_split({_APART}, chr(65535)), lambda p, i: CASE WHEN i % 2 = 0 THEN repeat('#', octet_length(encode(p))) ELSE p END), '')"


@check("V7_censor_wildcard", f"SELECT doc_id, {_sql_trim(_sql_censor(_HIDDEN, 'the', '###'))} AS masked FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.censor_words(C("text"), ["tion*", "the"]).alias("masked"))


@check("V7_highlight", "SELECT doc_id, regexp_replace(text, '(tion)', '<mark>\\1</mark>', 'gi') AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.highlight(C("text"), "tion").alias("text"))


_SPELLED = "text"
for _from, _to in {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue", "ß": "ss", "æ": "ae", "œ": "oe", "Œ": "OE", "Æ": "AE"}.items():
    _SPELLED = f"replace({_SPELLED}, '{_from}', '{_to}')"


@check("V7_ascii", f"SELECT doc_id, strip_accents({_SPELLED}) AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.to_ascii_letters(C("text")).alias("text"))


@check("V7_clean_steps", """
SELECT page_id, replace(replace(regexp_replace(html, '(^|[^:])//+', '\\1/', 'g'), '"', ''), '''', '') AS html FROM (
  SELECT page_id, regexp_replace(html, '(?:a){2,}', 'a', 'g') AS html FROM pages)
""")
def _(t):
    steps = [("reduce_multiples", {"character": "a"}), ("reduce_slashes", {}), ("strip_quotes", {})]
    return tx.text_prep(t.pages, steps, "html").select("page_id", "html")


@check("V7_slug", """
SELECT doc_id, trim(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(text, '<[^>]*>', '', 'g'), '&.+?;', '', 'g'), '[^\\p{L}\\p{N} _-]', '', 'g'), '\\s+', '-', 'g'), '(?:-)+', '-', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^(?:-)+|(?:-)+$', '', 'g')) AS slug FROM documents
""")
def _(t):
    return t.documents.select("doc_id", tx.url_slug(C("text"), lowercase=True).alias("slug"))


@check("V7_reduce_trim", """
SELECT p_partkey, regexp_replace(regexp_replace(replace(p_name, ' ', ',,') || ',,', ',{2,}', ',', 'g'), '^,+|,+$', '', 'g') AS name FROM part
""")
def _(t):
    text = F.concat(F.replace("p_name", F.lit(" "), F.lit(",,")), F.lit(",,"))
    return t.part.select("p_partkey", tx.reduce_multiples(text, trim=True).alias("name"))
