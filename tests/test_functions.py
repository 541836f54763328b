"""Scalar functions: text, time, numbers, validation, agents, job documents."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from runlens.functions import numbers, timefmt
from runlens.functions import text as tx
from runlens.operators import agents, hosts, jobs, validation


def value(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).first()[0]


@pytest.mark.parametrize(("text", "fn", "expected"), [
    ("one two three", lambda c: tx.word_limit(c, 2), "one two&#8230;"),
    ("one two ", lambda c: tx.word_limit(c, 2), "one two"),
    ("  ", lambda c: tx.word_limit(c, 2), "  "),
    (None, lambda c: tx.word_limit(c, 2), None),
    ("aaa bbb ccc ddd", lambda c: tx.char_limit(c, 7), "aaa bbb&#8230;"),
    ("aaa bbb ccc ddd", lambda c: tx.char_limit(c, 8), "aaa bbb&#8230;"),
    ("aaa bbb ccc ddd", lambda c: tx.char_limit(c, 9), "aaa bbb ccc&#8230;"),
    ("aaa\n\nbbb", lambda c: tx.char_limit(c, 7), "aaa bbb"),
    ("abcdefghij", lambda c: tx.ellipsize(c, 4), "abcd&hellip;"),
    ("abcdefghij", lambda c: tx.ellipsize(c, 4, 0.5), "ab&hellip;ij"),
    ("abcdefghij", lambda c: tx.ellipsize(c, 4, 0), "&hellip;ghij"),
    ("<b>abc</b> ", lambda c: tx.ellipsize(c, 4), "abc"),
    ("Darn it, darnit! DARN", lambda c: tx.censor_words(c, ["darn"]), "#### it, darnit! ####"),
    ("darn darn", lambda c: tx.censor_words(c, ["darn"]), "#### darn"),
    ("darned it", lambda c: tx.censor_words(c, ["darn*"]), "###### it"),
    ("a $5 darn", lambda c: tx.censor_words(c, ["darn"], "$x"), "a $5 $x"),
    ("Red red", lambda c: tx.highlight(c, "red"), "<mark>Red</mark> <mark>red</mark>"),
    ("Größe Æther Łódź ñ", lambda c: tx.to_ascii_letters(c), "Groesse AEther Lodz n"),
    ("Щука и Ёж", lambda c: tx.to_ascii_letters(c), "Shchuka i Yozh"),
    ("τψ", lambda c: tx.to_ascii_letters(c), "Tps"),
    ("plain", lambda c: tx.to_ascii_letters(c), "plain"),
    (",,a,,b,", lambda c: tx.reduce_multiples(c, ",", True), "a,b"),
    ("a..b", lambda c: tx.reduce_multiples(c, "."), "a.b"),
    ("it's \"x\"", lambda c: tx.strip_quotes(c), "its x"),
    ("http://a//b///c", lambda c: tx.reduce_slashes(c), "http://a/b/c"),
    (" What's <b>wrong</b> with CSS&amp;? ", lambda c: tx.url_slug(c, "_", True), "whats_wrong_with_css"),
    ("12 days", tx.to_int, 12),
    ("x12", tx.to_int, None),
    ("  joHN o'neil ", tx.clean_name, "John O'neil"),
])
def test_text(spark, text, fn, expected):
    assert value(spark, text, fn) == expected


def test_wildcard_censor_equals_brute_force(spark, tables):
    border = tx.WORD_BORDER

    def plain(text, words):
        text = f" {text} "
        for w in words:
            body = re.escape(w).replace(r"\*", r"\w*?")
            text = re.sub(f"({border})({body})({border})", lambda m: m[1] + "#" * len(m[2].encode()) + m[3], text, flags=re.I | re.A)
        return text.strip(tx.TRIM_CHARS)

    docs = tables.documents.select("doc_id", "text", tx.censor_words(F.col("text"), ["tion*", "the", "*que"]).alias("got"))
    for r in docs.collect():
        assert r.got == plain(r.text, ["tion*", "the", "*que"])


def test_steps_in_order(spark, tables):
    steps = [("strip_quotes", {}), ("word_limit", {"limit": 3, "end": ""}), ("url_slug", {"lowercase": True})]
    out = tx.text_prep(tables.documents, steps, out="slug")
    assert out.columns == [*tables.documents.columns, "slug"]
    assert all(r.slug.count("-") <= 2 for r in out.select("slug").collect())


T = dt.datetime


def test_running_time(spark):
    df = spark.createDataFrame([
        (T(2024, 1, 1), T(2024, 1, 3, 4, 5, 6)), (T(2024, 1, 31), T(2024, 3, 2)), (T(2024, 1, 1), T(2024, 2, 3)),
        (T(2024, 1, 1, 0, 0, 0, 900000), T(2024, 1, 1, 0, 0, 1, 100000)), (None, T(2024, 1, 1))], "a timestamp_ntz, b timestamp_ntz")
    got = [tuple(r) for r in df.select(timefmt.running_seconds(F.col("a"), F.col("b")), timefmt.running_text(F.col("a"), F.col("b"))).collect()]
    assert got[0] == (187506, "2 days, 04 hours, 05 minutes, 06 seconds")
    assert got[1][1] == "2 days, 00 hours, 00 minutes, 00 seconds"  # one month, then two days
    assert got[2][1] == "2 days, 00 hours, 00 minutes, 00 seconds"  # whole months are left out
    assert got[3] == (1, "0 days, 00 hours, 00 minutes, 01 seconds")
    assert got[4][0] is None


@pytest.mark.parametrize(("ms", "wrapped", "total"), [
    (3_723_004, "01 Hours,  02 Minutes,  03 Seconds,  004 Miliseconds.", "01 Hours,  02 Minutes,  03 Seconds,  004 Miliseconds."),
    (90_000_000, "01 Hours,  00 Minutes,  00 Seconds,  000 Miliseconds.", "25 Hours,  00 Minutes,  00 Seconds,  000 Miliseconds."),
])
def test_milliseconds(spark, ms, wrapped, total):
    c = F.lit(ms).cast("bigint")
    assert tuple(spark.range(1).select(timefmt.ms_text(c), timefmt.ms_text(c, False)).first()) == (wrapped, total)


@pytest.mark.parametrize(("sec", "uptime", "span"), [
    (36545627, "1 year, 57 days, 23 hours and 33 minutes", "1 Year, 1 Month, 3 Weeks, 6 Days, 7 Hours, 4 Minutes"),
    (59, None, "59 Seconds"), (0, None, "1 Second"), (3600, "1 hour", "1 Hour"), (86460, "1 day and 1 minute", "1 Day, 1 Minute"),
])
def test_elapsed(spark, sec, uptime, span):
    c = F.lit(sec).cast("bigint")
    got = spark.range(1).select(timefmt.human_time(c), timefmt.timespan(c)).first()
    assert got[0] == uptime
    if sec != 36545627:
        assert got[1] == span
    else:
        assert got[1].startswith("1 Year, 1 Month")


@pytest.mark.parametrize(("n", "size", "bytes_"), [
    (0, "0 B", "0 Bytes"), (1000, "1000 B", "1.0 KB"), (1024, "1024 B", "1.0 KB"), (1025, "1 KB", "1.0 KB"),
    (1536, "1.5 KB", "1.5 KB"), (10**6, "976.56 KB", "1.0 MB"), (5 * 10**9, "4.66 GB", "4.7 GB"), (3 * 10**15, "2.66 PB", "2,728.5 TB"),
])
def test_sizes(spark, n, size, bytes_):
    c = F.lit(n).cast("bigint")
    assert tuple(spark.range(1).select(numbers.human_size(c), numbers.byte_format(c)).first()) == (size, bytes_)


def test_half_up(spark):
    xs = [(-2.5,), (-0.5,), (0.5,), (1.4,), (2.5,)]
    assert [r[0] for r in spark.createDataFrame(xs, "x double").select(numbers.half_up(F.col("x"))).collect()] == [-2, 0, 1, 1, 3]


@pytest.mark.parametrize(("text", "day"), [
    ("202402", "2024-02-01"), ("022024", "2024-02-01"), ("20240229", "2024-02-29"), ("2-9-2024", "2024-02-09"),
    ("2024-02-09", "2024-02-09"), ("20241332", None), ("soon", None), ("", None), (None, None),
])
def test_parse_date(spark, text, day):
    got = value(spark, text, timefmt.parse_date)
    assert (got.isoformat() if got else None) == day


@pytest.mark.parametrize(("day", "expected"), [(1, "1st"), (2, "2nd"), (3, "3rd"), (4, "4th"), (11, "11th"), (12, "12th"), (13, "13th"), (21, "21st"), (31, "31st")])
def test_ordinals(spark, day, expected):
    assert value(spark, f"2024-01-{day:02}", lambda c: timefmt.ordinal_day(c.cast("date"))) == expected


def test_cron(spark):
    got = value(spark, "@daily", timefmt.cron_fields)
    assert got.tag == "@daily" and got.minute is None
    got = value(spark, "H/5 4 * *", timefmt.cron_fields)
    assert (got.minute, got.hour, got.day_of_week, got.tag) == ("H/5", "4", None, None)


# ---------------------------------------------------------------- validation


def passes(spark, text, rule):
    df = spark.createDataFrame([(1, text, "same")], "id int, v string, other string")
    return validation.violations(validation.check_rows(df, {"v": [rule]}, "id"), "id").isEmpty()


@pytest.mark.parametrize(("rule", "good", "bad"), [
    ("required", ["x"], ["", "  ", None]),
    (("min_length", 3), ["abc", "äöü", "", None], ["ab"]),
    (("max_length", 3), ["abc", "äöü"], ["abcd"]),
    (("exact_length", 3), ["abc"], ["ab", "abcd"]),
    ("valid_email", ["a@b.co", "a.b+c@sub.example.com"], ["a", "a@b", "a b@c.de", "a@@b.co", ".a@b.co", "a@-b.co"]),
    ("valid_emails", ["a@b.co", "a@b.co, c@d.org", "a@b.co,"], ["a@b.co,x"]),
    ("valid_url", ["http://a.b/c?d=1", "https://example.com", "example.com/x", "//example.com"], ["ftp://a.b", "http://", "a b.c"]),
    ("valid_ip", ["1.2.3.4", "255.255.255.255", "::1", "2001:db8::ff00:42:8329", "1:2:3:4:5:6:7:8"], ["256.1.1.1", "1.2.3", "1::2::3", "12345::", "1:2:3:4:5:6:7:8:9"]),
    (("valid_ip", "ipv4"), ["1.2.3.4"], ["::1"]),
    ("alpha", ["abC"], ["ab1"]),
    ("alpha_numeric", ["ab1"], ["a b"]),
    ("alpha_numeric_spaces", ["a b1"], ["a-b"]),
    ("alpha_dash", ["a-b_1"], ["a b"]),
    ("numeric", ["1", "-1.5", "+.5"], ["1.", "x", "1e5"]),
    ("integer", ["-7"], ["1.0"]),
    ("decimal", ["1.0"], ["1"]),
    ("natural", ["0", "7"], ["-1"]),
    ("natural_no_zero", ["7", "07"], ["0", "00"]),
    (("less_than", 5), ["4.9"], ["5", "x"]),
    (("less_than_equal", 5), ["5"], ["5.1"]),
    (("greater_than", 5), ["5.1"], ["5"]),
    (("greater_than_equal", 5), ["5"], ["4"]),
    (("in_list", ["a", "b"]), ["a"], ["c"]),
    (("matches", "other"), ["same"], ["x", "", None]),
    (("differs", "other"), ["x"], ["same"]),
    (("regex", "^a"), ["ab"], ["ba"]),
    ("base64", ["aGVsbG8=", "aGk="], ["aGVsbG8", "%%%", "aGk"]),
])
def test_rules(spark, rule, good, bad):
    assert [g for g in good if not passes(spark, g, rule)] == []
    assert [b for b in bad if passes(spark, b, rule)] == []


def test_unique_against_existing_and_within(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None), (5, None)], "id int, v string")
    old = spark.createDataFrame([("a",), ("z",)], "v string")
    bad, good = validation.validate_rows(new, {"v": [("is_unique",)]}, "id", existing=old)
    assert rows(bad, "id") == [(1,), (3,)] and rows(good, "id") == [(2,), (4,), (5,)]


def test_first_or_all_violations(spark):
    df = spark.createDataFrame([(1, "a!")], "id int, v string")
    rules = {"v": ["required", ("min_length", 3), "alpha"]}
    assert rows(validation.violations(validation.check_rows(df, rules, "id"), "id")) == [(1, "v", "min_length")]
    every = validation.check_rows(df, rules, "id", first_only=False)
    assert rows(validation.violations(every, "id")) == [(1, "v", "alpha"), (1, "v", "min_length")]


# ---------------------------------------------------------------- agents, documents, hosts


@pytest.mark.parametrize(("agent", "platform", "label", "mobile"), [
    ("Mozilla/5.0 (Windows NT 6.1; Trident/7.0; rv:11.0) like Gecko", "Windows 7", "Internet Explorer 11.0", None),
    ("Opera/9.80 (X11; Linux i686) Presto/2.12 Version/12.16", "Linux", "Opera 12.16", None),
    ("Mozilla/5.0 (Linux; Android 9; SAMSUNG SM-G) Chrome/63.0 Mobile Safari/537", "Android", "Chrome 63.0", "Samsung"),
    ("Mozilla/5.0 (compatible; bingbot/2.0)", "Unknown Platform", "Bing", None),
    ("curl", "Unknown Platform", "Unidentified User Agent", None),
    ("Nokia6100", "Unknown Platform", "Nokia", "Nokia"),
])
def test_agents(spark, agent, platform, label, mobile):
    df = spark.createDataFrame([(agent,)], "agentString string")
    got = agents.classify_agents(df).first()
    assert (got.platform_name, got.agent_label, got.mobile) == (platform, label, mobile)


def test_unreadable_session(spark):
    df = spark.createDataFrame([(1, "no json"), (2, '{"role":"1","roleText":"Admin","name":"x"}')], "id int, sessionData string")
    assert rows(agents.expand_sessions(df)) == [(1, None, None, None), (2, "1", "Admin", "x")]


def test_empty_job_document(spark):
    df = spark.createDataFrame([("a", "<project><description>d</description></project>")], "job string, xml string")
    got = jobs.extract_jobs(df).first().asDict()
    assert got.pop("job") == "a" and got.pop("description") == "d" and set(got.values()) == {None}


def test_disks(spark):
    d = spark.createDataFrame([
        (1, "h", "/", "ext4", "/dev/sda", 4096, 1024, 3072, 130), (2, "h", "/", "ext4", "/dev/sdb", 8192, 1, 1, 1),
        (3, "h", "/run", "tmpfs", "tmpfs", 1, 1, 1, 1), (4, "h", "/snap", "squashfs", "/dev/loop1", 1, 1, 1, 1)],
        "id int, host string, mount string, type string, filesystem string, total long, used long, free long, percent int")
    assert rows(hosts.disk_usage(d, "id"), "id", "total_size", "percent") == [(1, "4 MB", 100)]
    assert hosts.disk_usage(d, "id", ["/"], True, True).count() == 2
