import pytest

from tokenloom.functions import text as T


@pytest.mark.parametrize(
    "text, tokens",
    [("", 1), ("one", 2), ("a b c", 4), ("a,b;c:d", 6), ('say "hi" [now] {x}', 6), ("... !!!", 1)],
)
def test_token_count(one, text, tokens):
    assert one(T.token_count, text) == tokens


def test_token_variants(one):
    assert one(T.token_count_unfloored, "") == 0
    assert one(T.token_count_chinese, "你好 hello world") == 4
    assert one(T.token_count_proxy, "a b c d e") == 6
    assert one(T.token_count_proxy, "") == 1


def test_white_space_is_unicode(one):
    assert one(T.space_words, "a b c\x1cd") == 4
    assert one(T.strip, "　 a \x85") == "a"


def test_sentences(one):
    assert one(T.sentences, " One. Two!  Three? four") == ["One.", "Two!", "Three?", "four"]
    assert one(T.sentences, "   ") == []
    assert one(T.sentences, "v1.2 is out.No space") == ["v1.2 is out.No space"]


def test_entities(one):
    assert one(T.entities, "15% of 3 users") == ["15"]
    assert one(T.entities, "45 GB in EU by Acme Cloud at https://x.io/a?b=1.") == [
        "45",
        "GB",
        "EU",
        "Acme Cloud",
        "https://x.io/a?b=1.",
    ]
    assert one(T.entities, "paid 12,5 USD and 250ms") == ["12,5 USD", "250ms"]
    assert one(T.entities, "éAB ABé AB") == ["AB"]


def test_fact_density(one):
    assert one(T.fact_density, "timeout=30 here") == 1.0
    assert one(T.fact_density, "nothing to see") == 0.0
    words = " ".join(["word"] * 19) + " 42"
    assert one(T.fact_density, words) == pytest.approx(0.5)


def test_intent_score(one):
    assert one(T.intent_score, "please explain it") == 0.0
    assert one(T.intent_score, "please explain it now") == 6.0
    # goal 3 + constraint 2.5 + medium length 1
    assert one(T.intent_score, "I want a page that must load in time") == 6.5


def test_sentence_key_and_words(one):
    assert one(lambda c: T.sentence_key(c, 5), "A b-c: D_e f!") == "abcd_"
    assert one(T.words, "Über-Maß, x_1!") == ["über", "maß", "x_1"]
    assert one(T.words, " ... ") == []
