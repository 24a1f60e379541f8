import hashlib
import json
import random
import re

from usagelens.functions.pricing import default_prices
from usagelens.operators import account_quota, catalog, extract, surrogate
from usagelens_checks import tables

NAMES = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "parse_error")


def by_request(frame, names=NAMES):
    return {row.request_id: tuple(row[name] for name in names) for row in frame.collect()}


def json_usage(spark, bodies):
    raw = spark.createDataFrame(list(enumerate(bodies)), "request_id long, body string")
    found = by_request(extract.extract_json_usage(raw))
    return [found[i] for i in range(len(bodies))]


def sse_usage(spark, streams, **options):
    rows = [(i, seq, chunk) for i, chunks in enumerate(streams) for seq, chunk in enumerate(chunks)]
    raw = spark.createDataFrame(rows, "request_id long, seq long, chunk string")
    found = by_request(extract.extract_sse_usage(raw, **options))
    return [found[i] for i in range(len(streams))]


def test_json_bodies(spark):
    assert json_usage(spark, [
        '{"usage":{"input_tokens":10,"output_tokens":20,"input_tokens_details":{"cached_tokens":5}}}',
        '{"usage":{"prompt_tokens":7,"completion_tokens":8,"prompt_tokens_details":{"cached_tokens":2}}}',
        '{"id":"x"}', '{"usage":null}', '{"usage":[]}', '{"usage":[1]}', "[]", "oops", None, "7",
        '{"usage":{"input_tokens":"abc","output_tokens":3}}',
    ]) == [(10, 20, 0, 5, False), (7, 8, 0, 2, False), (0, 0, 0, 0, False), (0, 0, 0, 0, False), (0, 0, 0, 0, False),
           (0, 0, 0, 0, True), (0, 0, 0, 0, True), (0, 0, 0, 0, True), (0, 0, 0, 0, True), (0, 0, 0, 0, True),
           (0, 0, 0, 0, True)]


def completed(**usage):
    return "data: " + json.dumps({"type": "response.completed", "response": {"usage": usage}}) + "\n\n"


def test_stream_cut_inside_an_event(spark):
    text = ('event: response.created\ndata: {"type":"response.created"}\n\n'
            'data: {"type":"response.in_progress","response":{"usage":null}}\n\n'
            + completed(input_tokens=1200, output_tokens=456, input_tokens_details={"cached_tokens": 300})
            + "data: [DONE]\n\n")
    assert sse_usage(spark, [(text[:80], text[80:])]) == [(1200, 456, 0, 300, False)]


def test_stream_rules(spark):
    one, two = completed(input_tokens=1), completed(input_tokens=2)
    cases = [
        ((one + two,), 2, False),                                       # the last usage wins
        ((one + 'data: {"usage":{}}\n',), 1, False),                    # an empty usage does not
        ((one + 'data: {"usage":{},"response":{"usage":{"input_tokens":9}}}\n',), 1, False),
        ((one + 'data: {"usage":null,"response":{"usage":{"input_tokens":9}}}\n',), 9, False),
        (("  \t" + one,), 1, False),                                    # indented
        ((one + "data: 12\n",), 0, True),                               # an event that is no object
        ((one + "data: null\n",), 0, True),
        ((one + "data: nonsense\ndata:\ndata: [DONE]\n",), 1, False),
        ((one + 'data: {"usage":{"input_tokens":"abc"}}\n' + two,), 0, True),
        ((one + 'data: {"usage":5}\n',), 0, True),
        (('data: {"usage":{"input_tokens":3,"x":"a\u2028b"}}\n',), 0, False),  # a separator cuts the line
        (('data: {"\\u0075sage":{"input_tokens":4}}',), 4, False),      # escaped key, no final line break
        (("",), 0, False),
        ((None, "data: {\"usage\":{\"input_", "tokens\":", "6}}", "\r", "\ndata: [DONE]"), 6, False),
    ]
    found = sse_usage(spark, [chunks for chunks, _, _ in cases])
    assert [(row[0], row[4]) for row in found] == [(count, bad) for _, count, bad in cases]


def last_usage(text):
    """Plain reading of a stream whose usages are all well formed."""
    count = 0
    for line in re.split("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", text):
        if line.startswith("data: {"):
            try:
                count = json.loads(line[6:])["usage"]["input_tokens"]
            except (ValueError, KeyError):
                pass
    return count


def test_random_cuts_and_slices(spark):
    rng = random.Random(3)
    streams, expected = [], []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 12)):
            parts.append(rng.choice([
                'data: {"usage":{"input_tokens":%d}}' % rng.randint(1, 99), 'data: {"delta":"x"}', "event: e", "",
                'data: {"broken"']))
            parts.append(rng.choice(["\n", "\r\n", "\n\n", "\u2028", "\x1d"]))
        text = "".join(parts)
        cuts = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 15)))
        streams.append([text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])])
        expected.append(last_usage(text))
    for options in ({"chunks_per_slice": 1}, {"chunks_per_slice": 3}, {}):
        assert [row[0] for row in sse_usage(spark, streams, **options)] == expected


def test_one_long_request(spark):
    """Thousands of chunks of one request, events cut anywhere, beside short requests."""
    rng = random.Random(9)
    text = "".join('data: {"delta":"%s"}\n\n' % ("x" * rng.randrange(60)) for _ in range(2500))
    text += 'data: {"usage":{"input_tokens":41}}\n\n' + text + 'data: {"usage":{"input_tokens":42}}\n\n' + text[:70_000]
    chunks = [text[at:at + 40] for at in range(0, len(text), 40)]
    assert len(chunks) > 2 * extract.CHUNKS_PER_SLICE
    streams = [chunks, ['data: {"usage":{"input_tokens":1}}\n'], chunks[:100]]
    assert [row[0] for row in sse_usage(spark, streams)] == [42, 1, 0]


def test_request_facts(spark):
    rows = [(0, '{"model":"m","stream":true}', "Codex Desktop", "k", None), (1, '{"stream":0,"model":null}', None, "", "Bearer b"),
            (2, "[]", "curl", None, None), (3, "x", "codex", None, "Basic z"), (4, '{"model":5,"stream":"no"}', "", "", ""),
            (5, None, None, None, None)]
    frame = spark.createDataFrame(rows, "request_id long, payload string, user_agent string, x_api_key string, authorization string")
    found = by_request(extract.request_facts(frame), ("model", "stream", "client", "api_key"))
    assert found == {0: ("m", 1, "desktop", "k"), 1: ("None", 0, "other", "b"), 2: ("", 0, "other", ""),
                     3: ("", 0, "cli", ""), 4: ("5", 1, "other", ""), 5: ("", 0, "other", "")}


def test_assembly(spark):
    rows = [(1, "a", "k", "gpt-5.5", 1, "cli", 200, 1704038400000 - 10, 1704038400000, "/p", None),
            (2, "a", "k", "gpt-5.5", 0, "cli", 500, 1704038400000 - 10, 1704038399999, "/p", "e" * 300),
            (3, "a", "k", "gpt-5.5", 1, "cli", 200, 1704038400000, 1704038400001, "/p", None),
            (4, "a", "k", "gpt-5.5", 0, "cli", 200, 1704038400000, 1704038400001, "/p", None),
            (5, "a", "k", "gpt-5.5", 1, "cli", None, 1704038400000, 1704038400001, "/p", None)]
    requests = spark.createDataFrame(rows, "request_id long, username string, api_key string, model string, stream int, "
                                           "client string, status int, start_ms long, ts_ms long, path string, error string")
    counts = spark.createDataFrame(
        [(1, 10, 20, 0, 0, False), (2, 10, 20, 0, 0, False), (3, 0, 0, 0, 0, True), (4, 0, 0, 0, 0, True), (5, 9, 9, 9, 9, True)],
        "request_id long, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, "
        "parse_error boolean")
    found = {row.id: row for row in extract.assemble_usage(requests, counts, default_prices(), "Asia/Shanghai").collect()}
    assert (found[1].day, found[1].cost_micros, found[1].latency_ms) == ("2024-01-01", 650, 10)
    assert (found[2].day, found[2].input_tokens, found[2].cost_micros, len(found[2].error)) == ("2023-12-31", 0, 0, 300)
    # A stream without a readable usage failed; a body without one did not.
    assert [(found[i].status, found[i].error) for i in (3, 4, 5)] == [extract.VOID_STREAM, (200, None), (None, None)]
    cut = extract.assemble_usage(requests, counts, default_prices(), "Asia/Shanghai", error_chars=200)
    assert max(len(row.error or "") for row in cut.collect()) == 200


def test_long_values_and_equal_keys(spark):
    """Text values beyond the parser's limit of twenty million characters; of equal keys the last one counts."""
    long = "x\\\"é" * 5_500_000
    usage = '"usage":{"input_tokens":1,"input_tokens":7,"output_tokens":3}'
    bodies = [(1, f'{{"t":"{long}",{usage}}}'), (2, f'{{"a":1,"a":2,{usage}}}'), (3, f'{{"t":"{long}",{usage}')]
    found = extract.extract_json_usage(spark.createDataFrame(bodies, "request_id long, body string")).collect()
    assert [(row.input_tokens, row.output_tokens, row.parse_error) for row in sorted(found)] == [
        (7, 3, False), (7, 3, False), (0, 0, True)]
    chunks = [(row, 0, f"data: {body}\n\n") for row, body in bodies]
    streams = extract.extract_sse_usage(spark.createDataFrame(chunks, "request_id long, seq long, chunk string")).collect()
    assert [(row.input_tokens, row.output_tokens, row.parse_error) for row in sorted(streams)] == [
        (7, 3, False), (7, 3, False), (0, 0, True)]


def test_chunk_numbers_from_any_start(spark):
    line = 'data: {"usage":{"input_tokens":7,"output_tokens":3}}\n'
    for start, per_slice in ((-1, 2048), (-30, 4), (2047, 2048), (10 ** 12, 3)):
        chunks = [(1, start + i, line[i:i + 1]) for i in range(len(line))]
        found = extract.extract_sse_usage(
            spark.createDataFrame(chunks, "request_id long, seq long, chunk string"), per_slice).first()
        assert (found.input_tokens, found.output_tokens, found.parse_error) == (7, 3, False)


def test_long_documents_are_cut_in_one_pass(spark):
    texts = ["", "x", "\U0001f600 a\r\n\u2028" * 40, 'He said "\\u0041" \t' * 30]
    documents = spark.createDataFrame([(i, text) for i, text in enumerate([*texts, None])], "doc_id long, text string")
    chunks = tables.long_chunks_of(documents)
    assert [kind for _, kind in chunks.dtypes] == ["bigint", "bigint", "string"]
    # A substring for each place starts from the beginning each time: quadratic in the document.
    assert "substring(" not in chunks._jdf.queryExecution().optimizedPlan().toString()
    found = {}
    for row in chunks.collect():
        found.setdefault(row.request_id, {})[row.seq] = row.chunk
    assert sorted(found) == [0, 1, 2, 3]
    for i, text in enumerate(texts):
        pieces = [found[i][seq] for seq in sorted(found[i])]
        assert sorted(found[i]) == list(range(-5, len(pieces) - 5))
        assert {len(piece) for piece in pieces[:-1]} == {8} and 1 <= len(pieces[-1]) <= 8
        event = "".join(pieces).split("\n\n")[1].removeprefix("data: ")
        assert json.loads(event)["response"] == {
            "output": {"text": text}, "usage": {"input_tokens": len(text), "output_tokens": i}}


def test_only_long_chunks_are_squeezed_alone(spark):
    noise = "data: {}\x0b\u2028event: x\r\n"
    text = noise * 9 + completed(input_tokens=1) + noise * 90 + completed(input_tokens=2, pad="p" * 400) + noise * 40
    streams = [[text], [text[i:i + 300] for i in range(0, len(text), 300)], [text[i:i + 7] for i in range(0, len(text), 7)],
               [text[:40], text[40:900], text[900:950], text[950:]]]
    for size in (1, 3, 2048):
        assert sse_usage(spark, streams, chunks_per_slice=size) == [(2, 0, 0, 0, False)] * 4
    short = spark.createDataFrame([(1, 0, "a\nb\nc"), (1, 1, "d\n" + "e\n" * 300 + "f")], "request_id long, seq long, chunk string")
    plan = extract.squeezed_slices(short)._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan
    assert extract.squeezed_slices(short).first().pieces == ["a", "f"]


def payload_ids(spark, payloads):
    frame = spark.createDataFrame(list(enumerate(payloads)), "request_id long, payload string")
    found = surrogate.surrogate_ids(surrogate.request_items(frame)).collect()
    return {(row.request_id, row.pos): row.new_id for row in found}


def test_surrogate_ids(spark):
    long_id, twin, alone, edge = "item_" + "a" * 80, "rs_" + "b" * 80, "rs_" + "c" * 80, "x" * 64
    payload = json.dumps({"input": [
        {"id": long_id, "m": {"id": "y" * 90}}, {"id": long_id}, {"id": alone, "encrypted_content": "e"}, {"id": edge},
        {"id": 5}, "text", {"id": twin}, {"id": twin, "encrypted_content": None}]})
    found = payload_ids(spark, [payload, '{"input":"text"}', '{"input":{"id":"x"}}', '{"input":null}', "{}"])
    assert len(found) == 8
    assert found[(0, 0)] == found[(0, 1)] and found[(0, 0)].startswith("rs_") and len(found[(0, 0)]) == 64
    assert (found[(0, 2)], found[(0, 3)], found[(0, 4)], found[(0, 5)]) == (alone, edge, None, None)
    assert found[(0, 6)] == found[(0, 7)] != twin


def windows(spark, payload, fetched_at=1704067200000):
    frame = spark.createDataFrame([(1, fetched_at, json.dumps(payload))], "snapshot_id long, fetched_at long, payload string")
    rows = account_quota.quota_windows(frame, "Asia/Shanghai").orderBy("position").collect()
    return [(row.label, row.used_percent, row.remaining_percent, row.severity, row.reset) for row in rows]


def test_quota_windows(spark):
    found = windows(spark, {
        "account_id": "secret",
        "rate_limit": {"primary_window": {"used_percent": 20, "limit_window_seconds": 604800, "reset_at": 1704067200}},
        "additional_rate_limits": [{"limit_name": "GPT-5.3-Codex-Spark", "rate_limit": {
            "primary_window": {"used_percent": 25, "limit_window_seconds": 18000, "reset_after_seconds": 60}}}]})
    assert found == [("本周", 20.0, 80.0, "low", "重置于 01-01 08:00"),
                     ("GPT-5.3-Codex-Spark · 5小时", 25.0, 75.0, "low", "重置于 01-01 08:01")]


def test_quota_window_edges(spark):
    def one(**window):
        return windows(spark, {"rateLimits": {"secondary_window": window}})

    assert one(used_percent=120, limit_window_seconds="216000") == [("2 天窗口", 100.0, 0.0, "high", "重置时间未知")]
    assert one(used_percent=-5, limit_window_seconds=9000) == [("2 小时窗口", 0.0, 100.0, "low", "重置时间未知")]
    assert one(used_percent="50", limit_window_seconds=60, reset_at="2024-01-05T10:00:00Z") == [
        ("周期窗口", 50.0, 50.0, "medium", "重置于 01-05 18:00")]
    assert one(used_percent=None) == [] and one(used_percent="many") == []
    assert one() == [("周期窗口", 0.0, 100.0, "low", "重置时间未知")]
    assert one(reset_at="soon", reset_after_seconds=5)[0][4] == "重置时间未知"
    assert one(reset_at="2024-01-05T10:00:00+02:00")[0][4] == "重置于 01-05 16:00"
    assert one(reset_at="2024-01-05T10:00:00")[0][4] == "重置于 01-05 10:00"
    assert windows(spark, []) == [] and windows(spark, {"rate_limit": 5}) == []


def test_model_catalog(spark):
    payloads = [
        {"models": ["a1", {"id": "a1", "slug": "b1"}, {"id": "bad id", "model": "c1"}, 7, {"id": None, "model_slug": "d1"}, "a1", "x" * 81]},
        {"models": {}, "data": [{"id": "z1"}, {"id": "line\n"}]}, {"models": []}, [1], {"data": 5}]
    frame = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "snapshot_id long, payload string")
    rows = catalog.model_catalog(frame).collect()
    assert sorted((row.snapshot_id, row.position, row.model_id) for row in rows) == [
        (0, 0, "a1"), (0, 1, "b1"), (0, 2, "c1"), (0, 3, "d1"), (1, 0, "z1")]
    merged = catalog.model_catalog_merged(frame, ["b1", "own"]).where("snapshot_id IN (0, 3)").collect()
    assert sorted((row.snapshot_id, row.position, row.model_id) for row in merged) == [
        (0, 0, "a1"), (0, 1, "b1"), (0, 2, "c1"), (0, 3, "d1"), (0, 4, "own"), (3, 0, "b1"), (3, 1, "own")]


def test_model_catalogs_against_a_plain_loop(spark):
    chance = random.Random(4)
    keys = catalog.ID_KEYS

    def item():
        one = {key: chance.choice(["a", "m1", "m2", "m3", "m4", "bad id", 7, None]) for key in chance.sample(keys, 3)}
        return chance.choice([one, f"m{chance.randint(0, 9)}", one, 5, "!"])

    lists = [[item() for _ in range(chance.randint(0, 8))] for _ in range(60)]
    lists.append([{"id": f"m{k // 2}", "slug": f"s{k}"} for k in range(100_000)])  # half of them fall through
    expected = []
    for items in lists:
        taken = []
        seen = set()
        for one in items:
            names = [one] if not isinstance(one, dict) else [one.get(key) for key in keys]
            fresh = [n for n in names if isinstance(n, str) and re.search(catalog.ID_PATTERN.replace("\\z", "\\Z"), n) and n not in seen]
            taken += fresh[:1]
            seen |= set(fresh[:1])
        expected.append(taken)
    frame = spark.createDataFrame([(i, json.dumps({"models": items})) for i, items in enumerate(lists)], "snapshot_id long, payload string")
    got = [[] for _ in lists]
    for row in sorted(catalog.model_catalog(frame).collect()):
        assert row.position == len(got[row.snapshot_id])
        got[row.snapshot_id].append(row.model_id)
    assert got == expected


def test_unread_long_event_behind_the_last_usage(spark):
    early, unread = completed(input_tokens=1), 'data: {"usage":{"input_tokens":9},"pad":[' + "1," * 600_000 + "\n\n"
    assert sse_usage(spark, [[early, unread], [unread, early], [early], [early, unread, early], [unread]]) == [
        (0, 0, 0, 0, True), (1, 0, 0, 0, False), (1, 0, 0, 0, False), (1, 0, 0, 0, False), (0, 0, 0, 0, True)]


def test_long_payloads_keep_ids_and_facts(spark):
    """Ids that differ in their last character stay apart however long the payload is, and equal those of a short one."""
    one, other = "i" * 1200 + "a", "i" * 1200 + "b"
    items = [{"content": "\"id\":\"no\" \\ {[", "id": one}, {"id": other, "m": {"id": "q"}}, {"id": one, "encrypted_content": 1}]

    def payload(pad):
        return json.dumps({"pad": pad, "input": items, "model": "m" * 1500, "x": "y" * 2000})

    escaped = payload("p" * 1_100_000).replace('"id": "iii', '"\\u0069d": "iii')
    texts = [payload("p"), payload("p\\\"" * 700_000), escaped, payload("\\" * 3_000_000 + '"')]
    found = payload_ids(spark, texts)
    for row in range(4):
        ids = [found[(row, pos)] for pos in range(3)]
        assert ids == [found[(0, 0)], found[(0, 1)], found[(0, 0)]] and ids[0] != ids[1]
        assert ids[0] == "rs_" + hashlib.sha256(one.encode()).hexdigest()[:61]
    nested = json.dumps({"model": {"a": "z" * 1300}, "pad": "p" * 1_000_000})
    told = json.dumps({"pad": '"model":{', "model": "n" * 1300, "more": "p" * 1_000_000})
    rows = [(k, text, "", "", "") for k, text in enumerate([*texts, nested, told])]
    frame = spark.createDataFrame(rows, "request_id long, payload string, user_agent string, x_api_key string, authorization string")
    models = {r.request_id: r.model for r in extract.request_facts(frame).collect()}
    assert [models[k] for k in range(4)] == ["m" * 1500] * 4
    assert models[4] == json.dumps({"a": "z" * 1300}, separators=(",", ":")) and models[5] == "n" * 1300


def test_payloads_are_parsed_once_for_surrogate_ids(spark):
    """Also where a long payload has keys with escapes that hold objects, and keys longer than what is kept of a text."""
    pad = '"pad":"' + "p\\\"" * 400_000 + '"'
    items = '[{"id":"%s"},{"id":{"x":"%s"}},{"id":"%s","encrypted_content":0}]' % (("i" * 1200,) * 3)
    texts = ['{"input":%s,%s}' % (items, pad), '{%s,"\\u0069d":{"y":"%s"},"input":%s}' % (pad, "z" * 2000, items),
             '{%s,"%s\\n":{"id":"a"},"input":%s}' % (pad, "k" * 1500, items)]
    rows = spark.createDataFrame(list(enumerate(texts)), "request_id long, payload string")
    found = surrogate.surrogate_ids(surrogate.request_items(rows))
    assert "parse_json" not in found._jdf.queryExecution().optimizedPlan().toString()
    short = "rs_" + hashlib.sha256(b"i" * 1200).hexdigest()[:61]
    assert {(r.request_id, r.pos): r.new_id for r in found.collect()} == {
        (k, pos): new for k in range(3) for pos, new in enumerate([short, None, short])}


def test_long_bodies_keep_padded_counts(spark):
    body = json.dumps({"pad": "p" * 1_000_001, "usage": {"input_tokens": "0" * 1500 + "7", "output_tokens": " " * 1500 + "3"}})
    found = extract.extract_json_usage(spark.createDataFrame([(1, body)], "request_id long, body string")).first()
    assert (found.input_tokens, found.output_tokens, found.parse_error) == (7, 3, False)


def test_short_streams_are_summed_unsorted_and_members_cast(spark):
    """No line is sorted, and no path is looked up that may be absent: each costs an exception."""
    raw = spark.createDataFrame([(1, 0, 'data: {"usage":{"input_tokens":1}}\n')], "request_id long, seq long, chunk string")
    plan = extract.extract_sse_usage(raw)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert "$.usage" not in plan and "$[1]" not in plan and "$.input_tokens" not in plan


def test_blanks_and_beginnings_of_payloads(spark):
    """Payloads are stripped of all blanks; what does not begin like JSON is none."""
    blanks = ["", " ", "\t", "\x1f", "\u00a0", " \u2003 ", "\u3000\t"]
    usage = 'data: {"usage":{"input_tokens":4}}\n'
    payloads = {"true": True, "null": True, "-1": True, "[1]": True, '"x"': True, "7e1": True, "nul": False, "nullx": False,
                "truth": False, "-": False, "+1": False, "NaN": False, "'x'": False, "\ufeff1": False, "x": False, "{": False}
    streams = [(usage, f"{one}data:{two}{text}{one}\n") for one in blanks for two in blanks for text in payloads]
    streams += [(f'{one}data:{two}{{"usage":{{"input_tokens":4}}}}{one}{two}\n',) for one in blanks for two in blanks]
    expected = [(0 if bad else 4, bad) for _ in blanks for _ in blanks for bad in payloads.values()] + [(4, False)] * len(blanks) ** 2
    assert [(row[0], row[4]) for row in sse_usage(spark, streams)] == expected


def test_usages_of_every_shape(spark):
    bodies = ['{"usage":{"x":1}}', '{"usage":{"cached_tokens":3}}', '{"usage":{"output_tokens":"5","completion_tokens":6}}',
              '{"usage":{"input_tokens_details":{"x":1},"input_tokens":2}}', '{"usage":{"input_tokens_details":"x"}}',
              '{"usage":{"prompt_tokens_details":[0],"prompt_tokens":2}}', '{"usage":{"input_tokens":{}}}',
              '{"usage":{"input_tokens":{"a":1}}}', '{"usage":"x"}', '{"usage":{"cached_tokens":null,"output_tokens":true}}']
    expected = [(0, 0, 0, 0, False), (0, 0, 0, 3, False), (0, 5, 0, 0, False), (2, 0, 0, 0, False), (0, 0, 0, 0, True),
                (0, 0, 0, 0, True), (0, 0, 0, 0, False), (0, 0, 0, 0, True), (0, 0, 0, 0, True), (0, 1, 0, 0, False)]
    assert json_usage(spark, bodies) == expected
    assert sse_usage(spark, [(f'data: {{"response":{body}}}\n',) for body in bodies]) == expected
