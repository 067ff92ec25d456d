"""Operators on tables of other shapes than the given ones."""

import numpy as np
import pytest

from docmill.llm import chat_format, hnsw, html_extract, queries


def test_chat_query_selects_a_layout(spark, tmp_path):
    """Tables of other roles and columns than the given ones' keep their turns and their loss."""
    plain = [(1, 0, "user", "ask"), (1, 1, "assistant", "say")]
    tables = {
        "rows": (plain, "conv_id long, turn long, role string, text string"),
        "names": ([(1, 0, "human", "ask"), (1, 1, "GPT", "say")], "conv_id long, turn long, role string, text string"),
        "from": ([(1, 0, "human", "ask"), (1, 1, "gpt", "say")], "conv_id long, turn int, from string, value string"),
        "lists": ([(1, [("human", "ask"), ("gpt", "say")])], "conv_id long, conversations array<struct<from: string, value: string>>"),
        "fields": ([(1, "ask", "say")], "conv_id long, prompt string, completion string"),
    }
    got = {}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
        got[name] = sorted(tuple(r) for r in queries.op4_chat_format(spark, f"{tmp_path}/{name}").collect())
    assert got["rows"][1][:2] == (1, 2) and got["rows"][1][3] == 3
    assert all(x == got["rows"] for x in got.values())
    spark.createDataFrame([(1, 2)], "conv_id long, other long").write.parquet(f"{tmp_path}/none/conversations.parquet")
    with pytest.raises(ValueError):
        queries.op4_chat_format(spark, f"{tmp_path}/none")


@pytest.mark.parametrize(
    "head",
    ["<head><title>T</title><body>", "<head><title>T</title>", "<head><meta name=a><style>p {}</style><script>x</script>\n<body class=x>", "<head/><title>T</title></head><body>", "<head><title>T</title></head><body>", "<body><svg/>"],
)
def test_pages_without_an_end_of_head(head):
    def texts(page):
        return [x.text for x in html_extract.in_order(html_extract.parse(page)) if x.text]

    article = "<article><h1>On ice</h1><p>The harbour was closed.</p><p>Ships came late, in spring.</p></article>"
    whole = f"<html><head><title>T</title></head><body>{article}</body></html>"
    assert texts(f"<html>{head}{article}</body></html>") == texts(whole) == ["On ice", "The harbour was closed.", "Ships came late, in spring."]
    assert html_extract.main_texts([f"<html>{head}{article}"], html_extract.model()) == ["On ice\n\nThe harbour was closed.\n\nShips came late, in spring."]


def test_text_ends_an_open_head():
    assert [x.text for x in html_extract.in_order(html_extract.parse("<head><title>T</title>Plain words<b>, bold</b>")) if x.text] == ["Plain words, bold"]


def test_neighbours_where_a_third_is_equal(spark):
    rng = np.random.RandomState(3)
    x = np.concatenate([rng.randn(2000, 16), np.repeat(rng.randn(1, 16), 1500, 0), np.zeros((1000, 16))])
    x[3500:] = x[2000] + 0.3 * rng.randn(1000, 16)
    x = x[rng.permutation(len(x))].astype(np.float32).astype(float)
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    got = {}
    for r in hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in range(0, len(x), 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [k for k in np.lexsort((np.arange(len(d)), d)).tolist() if k != q][:10]
        mine = [k for _, k, _ in sorted(got[q])]
        hits += len(set(mine) & set(want))
        if d[want[-1]] == 0:
            assert mine == want
    assert hits / (10 * len(got)) >= 0.95


def test_uneven_json_records_keep_their_turns(spark):
    said = {
        '{"instruction":"i","input":null,"output":"o"}': [("user", "i"), ("assistant", "o")],
        '{"id":7,"source":"s","prompt":"a","completion":"b"}': [("user", "a"), ("assistant", "b")],
        '{"prompt":"a","completion":"b","system":null,"messages":null}': [("user", "a"), ("assistant", "b")],
        '{"prompt":"a","completion":null,"system":null}': [("user", "a")],
        '{"system":"s","instruction":"i","input":"n","output":"o"}': [("system", "s"), ("user", "i"), ("user", "n"), ("assistant", "o")],
        '{"messages":[{"role":"human","content":"x","name":"n"},{"role":"gpt","content":null},{"role":"gpt"}],"id":{"a":1}}': [("user", "x"), ("assistant", None), ("assistant", None)],
        '{"conversations":[{"from":"human","value":"x","weight":0.5}],"model":"m"}': [("user", "x")],
        '{"instruction":"i","input":5,"output":"o"}': [(None, None)],
        '{"messages":[{"role":"user","content":["x"]}]}': [(None, None)],
        '{"messages":[7]}': [(None, None)],
        '{"messages":"x"}': [(None, None)],
        "[1]": [(None, None)],
    }
    got = {}
    for r in chat_format.json_turns(spark.createDataFrame(list(enumerate(said)), "id long, j string"), "id", "j").orderBy("id", "turn").collect():
        got.setdefault(r.id, []).append((r.role, r.text))
        assert (r.layout is None) == (r.role is None)
    assert list(got.values()) == list(said.values())


@pytest.mark.parametrize("pattern", ["<i><div>{b}{end}", "<ul><li><ul>{b}{items}", "<p><div>{b}{blocks}", "<a><table>{b}{cells}"])
def test_stray_and_open_tags_take_linear_time(pattern):
    """Four times the page takes about four times the time; a way that looks through what is open would take sixteen times."""
    import time

    def took(n):
        page = pattern.format(b="<b>" * n, end="</i>" * n, items="<li></li>" * n, blocks="<div></div>" * n, cells="<td></td>" * n)
        times = []
        for _ in range(3):
            began = time.perf_counter()
            html_extract.parse(page)
            times.append(time.perf_counter() - began)
        return min(times)

    assert took(16_000) < 9 * max(took(4_000), 0.005)
