"""Entries: starts by what follows, blocks, sections, health; titles that repeat."""

from trellis.operators import entries as E

BOOK = """前言
一枝黄花
Yizhihuanghua
SOLIDAGINIS HERBA
本品为菊科植物。
【性状】 长 30 cm。
【性味与归经】 辛、苦，凉。
【性状】 又见。
饮片
【炮制】 除去杂质。

丁公藤
本品由藤茎制成。
【性状】 斜切。
饮片
丁香
Dingxiang
Caryophylli Flos
【性味】 辛。
丁香
Dingxiang
CARYOPHYLLI FLOS
丁公藤
本品由藤茎制成。
饮片
饮片
Yinpian
DECOCTION
末"""
OTHER = "丁香\n本品为花蕾。"


def book(spark, *texts):
    rows = [(f"b{i}", no, line) for i, t in enumerate(texts) for no, line in enumerate(t.split("\n"), 1)]
    return spark.createDataFrame(rows, "path string, line_no int, line string")


def test_starts_blocks_and_sections(spark):
    lines = book(spark, BOOK, OTHER)
    found = E.starts(lines, "path")
    got = {(r.path, r.start): (r.title, r.rule, r.flags) for r in found.collect()}
    head, body = "three_line_header", "body_text_fallback"
    assert got == {
        ("b0", 2): ("一枝黄花", head, []), ("b0", 12): ("丁公藤", body, ["missing_english_header"]), ("b0", 16): ("丁香", head, ["third_line_contains_lowercase"]), ("b0", 20): ("丁香", head, []),
        ("b0", 23): ("丁公藤", body, ["missing_english_header"]), ("b1", 1): ("丁香", body, ["missing_english_header"]),
    }
    parsed = {(r.path, r.start): r for r in E.parsed(E.blocks(lines, found, "path")).collect()}
    first = parsed["b0", 2]
    assert first.end == 11 and first.text.startswith("一枝黄花\nYizhihuanghua") and first.text.endswith("除去杂质。")
    assert first.header_lines == ["Yizhihuanghua", "SOLIDAGINIS HERBA"] and first.base_description == "本品为菊科植物。"
    assert first.sections == {"性状": "又见。", "性味与归经": "辛、苦，凉。"} and first.piece_sections == {"炮制": "除去杂质。"}
    assert parsed["b0", 16].end == 19 and parsed["b0", 16].base_description is None and parsed["b0", 16].piece_sections == {}
    # the piece's mark must stand between lines; the last block runs to the book's end
    assert parsed["b0", 12].text.endswith("饮片") and parsed["b0", 12].piece_sections == {} and parsed["b0", 23].end == 29


def test_health_and_report(spark):
    lines = book(spark, BOOK, OTHER)
    checked = E.health(E.starts(lines, "path"), "path")
    labels = {(r.path, r.start): set(r.labels) for r in checked.collect()}
    assert labels["b0", 16] == {"header_third_line_mixed_case", "duplicate_title_with_distinct_headers"} and labels["b0", 20] == {"duplicate_title_with_distinct_headers"}
    assert labels["b0", 12] == labels["b0", 23] == {"header_missing_english", "duplicate_title_repeated"} and labels["b1", 1] == {"header_missing_english"} and labels["b0", 2] == set()
    told = {(r.section, r.what): r.n for r in E.report(lines, checked, "path").collect()}
    assert told["entries", "all"] == 6 and told["excluded", "饮片"] == 4 and told["repeated_titles", "all"] == 2 and told["suspicious", "all"] == 5


def test_lines_are_judged_by_those_behind_them(spark):
    cases = ["药\nAbc\nDef", "药名\nAbc\n中文", "药名\nAb\nDef", "药名\n\n本品为", "药名", "药名\nAbc", "药 名\nAbc\nDef", "名" * 21 + "\nAbc\nDef", "药名\n A-b c. \n(D)（e）f", "药名\n123\nDef", "药名\nAbc\nab1234567"]
    found = {r.path for r in E.starts(book(spark, *cases), "path").collect()}
    assert found == {"b8"}
    assert E.starts(book(spark, BOOK).limit(0), "path").collect() == []
