import pytest

from querytide.llm import queries, token_counts

from .shared import documents, hard_texts

tokenizers = pytest.importorskip("tokenizers")


def reference(vocabulary: token_counts.Vocabulary):
    pieces = [("<unk>", 0.0), *vocabulary.pieces]
    if vocabulary.byte_fallback:
        pieces += [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    return tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, 0, vocabulary.byte_fallback))


def library_count(tokenizer, text):
    if not text:
        return 0
    return len(tokenizer.encode("▁" + text.replace(" ", "▁")).ids)


def test_counts_equal_the_library_on_ties_and_unknowns():
    v = token_counts.Vocabulary((("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -2.0), ("▁▁", -1.5)), False, -3.0)
    counter, library = token_counts.Counter(v), reference(v)
    for text in ["a", "ab", "abab", "ba ab", "xx", "axxb  a", "  ", "abaxbab", "\n", "a\nb"]:
        assert counter.count(text) == library_count(library, text), text


def test_counts_equal_the_library_on_the_real_vocabulary(spark):
    v = token_counts.Vocabulary.from_model(queries.TOKENIZER)
    library = reference(v)
    got = {(r.doc_id, r.n_tokens) for r in token_counts.token_counts(documents(spark, extra=["n_tokens"]), queries.TOKENIZER).collect()}
    assert got == {(i, library_count(library, t)) for i, t, *_ in hard_texts()}


def test_a_full_cache_changes_nothing():
    v = token_counts.Vocabulary.from_model(queries.TOKENIZER)
    small, large = token_counts.Counter(v, cache=2), token_counts.Counter(v)
    for _, text, *_ in hard_texts():
        assert small.count(text) == large.count(text)


def test_empty_table(spark):
    assert token_counts.token_counts(documents(spark, []), queries.TOKENIZER).collect() == []
