from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from timberline.functions import masks as M
from timberline.functions import templates as T
from timberline.functions.text import match, tokens
from timberline.operators import parsing
from timberline.operators.masking import mask_catalogue, mask_report

#: rule, input, expected
CASES = [
    ("timestamp_all", "at 2024-03-05T06:07:08Z, ok", "at <TIMESTAMP>, ok"),
    ("timestamp_all", "2024/03/05 06:07:08.123+02:00 x", "<TIMESTAMP> x"),
    ("timestamp_all", "[05/Mar/2024:06:07:08 +0000]", "[<TIMESTAMP>]"),
    ("timestamp_all", "[Tue Mar 05 06:07:08.250 UTC] z", "[<TIMESTAMP>] z"),
    ("timestamp_all", "Mar  5 06:07:08 host", "<TIMESTAMP> host"),
    ("timestamp_all", "1709618828 1709618828123 3709618828 17096188281", "<TIMESTAMP> <TIMESTAMP> 3709618828 17096188281"),
    ("timestamp_all", "x2024-03-05T06:07:08Z", "x2024-03-05T06:07:08Z"),
    ("pid", "[pid 311] pid 9 TID 8 Pid 7", "<PID> <PID> <PID> Pid 7"),
    ("pid", "2048#3: x1#2", "<PID>: x1#2"),
    ("file_path", "open /srv/app/data.bin /a/b", "open <FILE_PATH> /a/b"),
    ("hex_address", "at 0x7ffe10a4 0xzz a0x1", "at <HEX_ADDR> 0xzz a0x1"),
    ("semver", "v3.11.0 1.0.0-beta.2+b7 1.2", "<VERSION> <VERSION> 1.2"),
    ("semver", "10.0.0.7", "<VERSION>.7"),
    ("number", "7 42 404 a404 404b 65536", "7 42 <NUM> a404 404b <NUM>"),
    ("database_url", "to postgres://app:pw@db.local:5432/shop now", "to <DB_URL> now"),
    ("database_url", "mongodb+srv://a:b@c.net/t redis://cache:6379 http://x", "<DB_URL> <DB_URL> http://x"),
    ("ipv4", "10.0.0.7:80 999.1.1.1 1.2.3", "<IP_ADDRESS>:80 <IP_ADDRESS> 1.2.3"),
    ("ipv6", "2001:db8:0:0:0:0:0:1 fe80:: ::1", "<IPV6_ADDRESS> <IPV6_ADDRESS> <IPV6_ADDRESS>"),
    ("ipv6", "2001:db8::7 x::1 12:30:59", "<IPV6_ADDRESS> x::1 <IPV6_ADDRESS>"),
    ("mac_address", "02:42:ac:11:00:02 00-1a-2b-3c-4d-5e 02:42", "<MAC_ADDRESS> <MAC_ADDRESS> 02:42"),
    ("port", "h:8443 :0443 :80.5 :123456 :80:90", "h:<PORT> :0443 :80.5 :123456 :<PORT>:<PORT>"),
    ("email", "ops@example.org, a@b x@y.co", "<EMAIL>, a@b <EMAIL>"),
    ("email", "x@y.com+z@w.org", "<EMAIL><EMAIL>"),
    ("uuid", "123e4567-e89b-42d3-a456-426614174000 123e4567-e89b", "<UUID> 123e4567-e89b"),
    ("trace_id", "0af7651916cd43dd8448eb211c80319c b7ad6b7169203331 b7ad6b716920333", "<TRACE_ID> <TRACE_ID> b7ad6b716920333"),
    ("http_method", "GET GETS get DELETE/", "<HTTP_METHOD> GETS get <HTTP_METHOD>/"),
    ("http_numeric_id", "/items/47/x /items/7 /o/4711?k /o/47x /o/99", "/items/<ID>/x /items/7 /o/<ID>?k /o/47x /o/<ID>"),
    ("query_string", '"/a?k=17&b" /c', '"/a?<QUERY>" /c'),
    ("user_agent_all", '"-" "curl/8.5.0" "mail"', '"-" "<USER_AGENT>" "mail"'),
    ("user_agent_all", '"GET /x" 1 "MOZILLA/5.0 (X)"', '"GET /x" 1 "<USER_AGENT>"'),
    ("bearer_token", "Authorization: BEARER abc.def.ghi;", "Authorization: Bearer <TOKEN>;"),
    ("api_key", "api_key=0123456789abcdef0123 token: short", "<API_KEY> token: short"),
    ("jwt", "t=eyJhbGci.eyJzdWIi.c2lnbmF0 eyJx.y.z", "t=<JWT> eyJx.y.z"),
]


def test_every_rule_has_cases():
    assert {c[0] for c in CASES} == set(M.RULE)


def test_rule_rows(spark):
    rows = spark.createDataFrame(CASES, "rule string, input string, expected string")
    for rule in M.RULE:
        got = rows.where(F.col("rule") == rule).withColumn(
            "got", M.apply_masks(F.col("input"), [rule])
        )
        for row in got.collect():
            assert row["got"] == row["expected"], (rule, row["input"])


def test_examples_are_masked_and_masks_settle(spark):
    for rule in M.RULES:
        rows = spark.createDataFrame([(e,) for e in rule.examples], "e string")
        once = M.apply_masks(F.col("e"), [rule.id])
        for row in rows.select(once.alias("once"), M.apply_masks(once, [rule.id]).alias("twice")).collect():
            assert rule.token in row["once"]
            if rule.id not in ("query_string", "user_agent_all", "bearer_token"):
                assert row["once"] == row["twice"]


def test_order_is_the_callers(spark):
    row = spark.createDataFrame([("peer 10.0.0.7",)], "b string")
    versions_first = row.select(M.apply_masks(F.col("b"), ["semver", "ipv4"])).first()[0]
    addresses_first = row.select(M.apply_masks(F.col("b"), ["ipv4", "semver"])).first()[0]
    assert versions_first == "peer <VERSION>.7"
    assert addresses_first == "peer <IP_ADDRESS>"


def test_selection():
    assert M.select_masks() == M.DEFAULT_IDS
    assert len(M.RULES) == 21 and len(M.DEFAULT_IDS) == 7
    with pytest.raises(ValueError):
        M.select_masks(["ipv4", "nothing"])


def test_unknown_ids_are_skipped_when_applied(spark):
    row = spark.createDataFrame([("10.0.0.7",)], "b string")
    assert row.select(M.apply_masks(F.col("b"), ["nothing", "ipv4"])).first()[0] == "<IP_ADDRESS>"


def test_labels_need_the_whole_token(spark):
    row = spark.createDataFrame([('x <PID> "<USER_AGENT>" ?<QUERY>',)], "t string")
    ids = ["pid", "http_numeric_id", "user_agent_all", "query_string"]
    labels = row.select(M.mask_labels(F.col("t"), ids)).first()[0]
    assert labels == ["Process / Thread ID", "Any User-Agent", "URL Query String"]
    assert row.select(M.template_tokens(F.col("t"))).first()[0] == ["<PID>", "<USER_AGENT>", "<QUERY>"]


def test_long_unbroken_text_is_no_trap(spark):
    texts = ["a" * 200_000, "<" * 50_000, "/a" * 50_000, "1." * 50_000, "a:" * 50_000, '"' + "x java " * 5_000]
    rows = spark.createDataFrame([(t,) for t in texts], "body string")
    assert mask_report(rows).count() == 21
    lines = rows.select(
        T.skeleton(T.masked_line(F.col("body"))).alias("s"), tokens(F.col("body")).alias("t"),
        match(F.col("body"), "a java", "MATCH_PHRASE").alias("m"),
        parsing.line_parts(F.col("body")).alias("p"),
    )
    assert lines.where("s is not null and t is not null and m is not null").count() == len(texts)


def test_report_and_catalogue(spark):
    rows = spark.createDataFrame([("10.0.0.1 10.0.0.2",), ("x",), (None,)], "body string")
    ipv4 = mask_report(rows).where("rule = 'ipv4'").first()
    assert (ipv4["rows"], ipv4["matches"], ipv4["active"], ipv4["category_order"]) == (1, 2, True, 0)
    assert mask_catalogue(spark).where("active").count() == 7


def test_masking_deals_its_lines_first(spark):
    """A source that gives all its records to one task leaves the masks to many."""
    from timberline.operators import masking

    logs = spark.range(10).coalesce(1).selectExpr("concat('x ', id) AS body", "TIMESTAMP '2024-01-01' AS timestamp")
    for rows in (masking.masked_counts(logs), masking.mask_report(logs)):
        assert "REBALANCE_PARTITIONS_BY_NONE" in rows._jdf.queryExecution().executedPlan().toString()
