import re
from collections import Counter

from codeatlas.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(words), len(repeated)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def test_counts_match_brute_force(docs, rows):
    got = quality.clean_lines(docs).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for g in got:
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == brute(texts[g.doc_id]), g.doc_id
        assert not (g.base_failed and g.kept)


def test_empty_table(empty):
    assert quality.clean_lines(empty).count() == 0


def test_lines():
    ok = lambda line: quality.line_passes(line, len(line.split()))
    assert ok("A plain sentence, with an end.") and ok("words without any end") and ok("Wow! It works.")
    assert not ok("Home | News | Sport | Contact") and not ok("so%%% much### noise$$$ here***")
    assert not ok("WE!! SHOUT!! AT!! YOU!!") and not ok("THIS LINE IS WRITTEN IN CAPITAL LETTERS ONLY")
    assert not ok("Please enable JavaScript") and not ok("--- ---")


def test_documents_that_lose_too_much_go():
    good = "\n".join(" ".join(f"word{i}x{k}" for k in range(6)) + "." for i in range(12))
    noise = "\n".join("Home | News | Sport | Page%d" % i for i in range(12))
    assert quality.judge(good)[6] and quality.judge(good + "\nHome | News | Sport")[6]
    assert not quality.judge(noise + "\n" + good[:300])[6]
    assert quality.judge(good + "\nHome | News | Sport")[10] == good


def test_capitals_are_counted_in_the_whole_line():
    ok = lambda line: quality.line_passes(line, len(line.split()))
    assert not ok("BUY NOW AND SAVE on ALL SHOES, BAGS AND COATS")
    assert not ok("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24 25 26 THIS LINE IS ALL CAPITALS")
    assert ok("ABCDEFGHIJKLMN abcdef") and not ok("ABCDEFGHIJKLMNO abcde") and ok("SHORT AND LOUD LINE")


def test_short_lines_that_recur_and_lines_of_links_go():
    good = "\n".join(" ".join(f"word{i}x{k}" for k in range(6)) + "." for i in range(12))
    often = "\n".join(f"{line}\nread it here" for line in good.split("\n"))
    assert quality.judge(often)[10] == good and quality.judge("read it here\nread it here\n" + good)[8] == 0
    ok = lambda line: quality.line_passes(line, len(line.split()))
    assert not ok("https://a.org/x www.b.org") and not ok("see http://a.org www.b.com") and ok("see http://a.org for more") and ok("awww.x y")


def test_sql_agrees_on_odd_lines(spark, rows, tmp_path):
    import duckdb

    from codeatlas.llm import queries

    odd = ["Home | News\nBUY NOW AND SAVE on ALL SHOES, BAGS AND COATS", "É" * 30 + " b", "ÀÉÎ a" * 9, "ⅣⅤ½ ², 漢字 x\n½\n²\nⅣ", "x\nx\nx\ny", "www.a.b\nhttp://x y", "ABCDEFGHIJKLMNO abcde\nǅ" + "Ab" * 12]
    odd += ["A" * n + "b" * m for n, m in ((14, 6), (15, 5), (15, 6), (40, 17), (40, 18))] + ["word " * 60 + "\n" + "Log in\n" * 4]
    table = [(i, t) for i, t in enumerate(odd + [r[1] for r in rows])] + [(None, "a b")]
    spark.createDataFrame(table, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op1_quality_rules"])
    names = [d[0] for d in want.description]
    want = [r for r in want.fetchall() if r[0] is not None]
    got = queries.op1_quality_rules(spark, str(tmp_path))
    assert sorted(got.columns) == sorted(names)
    got = got.filter("doc_id is not null").select(names).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert queries.op1_quality_rules(spark, str(tmp_path)).count() == len(table)
