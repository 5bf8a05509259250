"""Clashing columns, nulls and repeated rows for token counts and archives."""

import public_tokenizers
import sentencepiece

from trellis.llm import warc
from trellis.llm.token_counts import token_counts

PIECE = public_tokenizers.path("piece_bpe_32k.model")


def test_token_counts_of_repeated_rows_and_clashing_columns(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = ["same text"] * 40 + [None, None, "", "other", "long " * 5000]
    rows = [(i // 3 if i % 5 else None, t, "x", 1, "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, content string, n int, tokenizer string")
    got = sorted(map(str, (tuple(r)[:4] for r in token_counts(docs, PIECE).collect())))
    assert got == sorted(str((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096)) for i, t, *_ in rows)


def test_archives_of_several_a_task_and_a_large_page(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * (1 + i % 3), "clash") for i in range(60)] + [(100, "u", "x" * (17 << 20), "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive string").repartition(2)
    folder = warc.new_path(spark, "warc_test")
    manifest = warc.write_archives(pages, folder, archive_bytes=600)
    assert manifest.count() > 4 and sum(r.records for r in manifest.collect()) == 61
    got = {r.page_id: r for r in warc.read_archives(manifest).collect()}
    last = {}
    for i, _, h, _ in rows:
        last[h] = max(i, last.get(h, -1))
    assert {i: (r.payload_bytes, r.record_type, r.refers_to) for i, r in got.items()} == {i: (len(h), "response", None) if last[h] == i else (len(h), "revisit", last[h]) for i, _, h, _ in rows}
    assert warc.round_trip(spark.createDataFrame([(None, None, None)] * 2, "page_id long, url string, html string")).count() == 2
