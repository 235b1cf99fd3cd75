"""The guard of the rank table."""

import pytest

from graphlake.llm import vocab


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_entry_is_probed(monkeypatch, name):
    import public_tokenizers

    path, asked, right = public_tokenizers.path(name), [], vocab.RankTable.encode
    monkeypatch.setattr(vocab.RankTable, "encode", lambda self, chunks: asked.extend(chunks) or right(self, chunks))
    some, whole, _ = vocab.chunk_encoder.__wrapped__(path)
    assert some is not whole and len(asked) > 48_000 and {"the", "ing", "é"} <= set(asked)

    for wrong in asked[1000:1007]:  # wrong for one entry only, wherever a stride would fall
        bad = lambda self, chunks, wrong=wrong: [b"" if c == wrong else x for c, x in zip(chunks, right(self, chunks), strict=True)]
        monkeypatch.setattr(vocab.RankTable, "encode", bad)
        some, whole, _ = vocab.chunk_encoder.__wrapped__(path)
        assert some is whole
