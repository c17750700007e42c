import pytest

from folioscope.llm import secret_scans as S

WORDS = "generated encrypted mandatory incorrect unavailable persistence authentication confidential required unnecessary".split()


@pytest.mark.parametrize("word", WORDS)
def test_plain_words_in_a_credential_context_stay(word):
    for text in (f"the password is {word}", f"Your secret is {word.capitalize()}.", f"authorization is {word}, as said"):
        assert S.scan(text) == [] and S.redacted(text, S.scan(text)) == text


@pytest.mark.parametrize("value", ["Xk9#mQ2$vL7!pR4z", "zqxjvkwpqh", "qmzpwnxobv"])
def test_costly_values_are_still_found(value):
    assert [s[0] for s in S.scan(f"the password is {value}")] == ["guess"]
