import hashlib

from oracle_check import compare, duck

from swipewatch.llm import lines, urls
from swipewatch.llm.lines import drop_shared_lines


def plain(texts, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    seen = {}
    for t in texts:
        for k in {key(x) for x in (t or "").split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    for t in texts:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if not (key(x) and seen[key(x)] >= least)]
        yield "\n".join(kept), len(all_), len(all_) - len(kept)


def test_equals_plain_rule(frame):
    rows = [(1, "A\nb\n\n c \r\nB"), (2, " a\t\nB"), (3, None), (3, None), (4, ""), (5, "\n\n"), (6, "É\nx"), (7, "é\nX\nlong " + "w " * 5000), (6, "É\nx")]
    for few in (0, 10**6):  # both joins
        out = drop_shared_lines(frame(rows, "doc_id long, text string"), min_docs=2, broadcast_keys=few).collect()
        want = sorted(zip([r[0] for r in rows], plain([r[1] for r in rows], 2), strict=True))
        assert sorted((r.doc_id, (r.text, r.n_lines, r.n_dropped)) for r in out) == want


def test_columns_and_empty_table(frame):
    out = drop_shared_lines(frame([("x", 1, None)], "text string, n_lines int, _pos string"))
    assert out.columns == ["text", "n_lines", "_pos", "_n_lines", "n_dropped"] and tuple(out.first()) == ("x", 1, None, 1, 0)
    assert drop_shared_lines(frame([], "text string")).count() == 0


def test_queries_equal_sql(spark):
    con = duck("/root/testdata/sf0.01")
    for fn, sql in ((lines.op6_line_dedup, lines.SQL), (urls.op8_url_filters, urls.SQL)):
        ok, note, _ = compare(spark, con, "/root/testdata/sf0.01", fn.__name__, fn, sql)
        assert ok, note
    assert len(hashlib.sha256(b"").hexdigest()) == 64
