"""Texts that hold an added token are encoded as the library does by default."""

from feedloom.llm import token_files


def test_added_tokens_are_the_librarys(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "x<|endoftext|>", "plain words", "<|endoftext|> <|endoftext|>\nword", "<|endof text|> plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in token_files.encoded(docs, path=str(tmp_path / "t")).collect()}
    assert got == {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert 50256 in got[0] and 50256 not in got[4]
