import random
from difflib import SequenceMatcher

import pytest
from conftest import rows

from chronoweave.llm.leakage import Automaton, leaks, own_wording, plain, reach
from chronoweave.llm.subjects import subject_areas
from chronoweave.llm.tokenizer import VOCABULARIES, encode_texts, encoder


@pytest.fixture(scope="module")
def enc():
    try:
        return encoder(open(f"{VOCABULARIES}/byte_bpe_50k.tiktoken", "rb").read())
    except OSError:
        pytest.skip("no vocabulary files here")


def texts():
    rng = random.Random(4)
    odd = ["", " ", "a\x1cb \x1d c", "a\x85b  \x85 c", "=" * 999, "x" * 3000, "日本語 🇨🇭 👍🏽", "<|endoftext|> hi", "​ a", "aaaa" * 300 + "bcd" * 90, "\x00\x01", "don't WE'LL"]
    return odd + ["".join(rng.choice("abcdefghijklmnop ABC '.019é\n") for _ in range(rng.randrange(1, 80))) for _ in range(400)] + ["".join(rng.choice("abetinors") for _ in range(200)) for _ in range(40)]


def test_ids_equal_the_public_tokenizer(enc):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in texts():
        assert enc.encode(text) == t.encode(text, add_special_tokens=False).ids, text[:50]


def test_encode_frame(spark, enc):
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "hello world", "c"), (3, "hello world", "c"), (4, "word " * 20000, "c")], "doc_id long, text string, ids string")
    got = rows(encode_texts(df, "doc_id", "text"))
    assert [(i, len(x)) for i, x in got] == [(1, 0), (2, 0), (3, 2), (3, 2), (4, 20001)]
    assert rows(encode_texts(df.limit(0), "doc_id", "text")) == []


ITEM = "Answer briefly.\n\nThe quick amber fox carries every sealed letter over nine frozen bridges before the silent baker opens her small shop. Nobody counts the lanterns twice. Old rivers keep names."
OTHER = "Answer briefly.\n\nSeven clerks sorted purple stamps near the harbour while a tired captain measured rope and salt against the morning tide again."
BODY = "The quick amber fox carries every sealed letter over nine frozen bridges before the silent baker opens her small shop"


def swap(text, *at):
    w = text.split()
    for i in at:
        w[i] = "zzz"
    return " ".join(w)


DOCS = {
    1: "intro " + BODY.upper().replace(" ", "  ") + " outro",
    2: "x " + swap(BODY, 9) + " y",  # one changed of twenty
    3: "x " + " ".join(BODY.split()[:8] + ["really"] + BODY.split()[8:]) + " y",  # one added
    4: " ".join(BODY.split()[:12]),  # a scrap
    5: swap(BODY, 2, 6, 10, 14, 18),  # too many changes
    6: "Answer briefly.",  # only the shared instruction
    7: "Old rivers keep names. Then: nobody counts the lanterns twice! " + BODY.replace("amber", "**amber**"),
    8: BODY.replace("sealed", "<b>sealed</b>").replace("frozen", "fro­zen"),
    9: None, 10: "", 11: "   ",
    12: "filler " * 30000 + BODY,
    13: "stamps harbour captain amber fox letter bridges baker shop lanterns rivers names ledger quick silent small nine frozen",
}


def test_leaks(spark):
    docs = spark.createDataFrame([(k, v, "c") for k, v in DOCS.items()] + [(1, DOCS[1], "c")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(70, ITEM), (70, ITEM), (71, OTHER), (72, None), (73, "")], "item_id long, text string")
    want = sorted([(k, 70) for k in (1, 2, 3, 7, 8, 12)], key=repr)
    assert rows(leaks(docs, items)) == want
    assert rows(leaks(docs, items, block_chars=10)) == want
    assert rows(leaks(docs, items.limit(0))) == [] == rows(leaks(docs.limit(0), items))


def test_short_sentences_in_another_order():
    item = "Blue kites rise above quiet fields today. Grey boats drift along narrow canals slowly. Red carts roll past empty markets daily."
    a = Automaton([(1, item)])
    s = item.split(". ")
    assert a.leaked(f"{s[1]}. Some other words stand here. {s[0]}. {s[2]}") == [1]
    assert a.leaked(f"{s[1]}. Some other words stand here. {s[0]}.") == []


def test_seeds_are_longest_matches():
    rng = random.Random(6)
    for _ in range(30):
        seqs = [[rng.choice("abcd") for _ in range(40)] for _ in range(3)]
        a = Automaton([(i, " ".join(s)) for i, s in enumerate(seqs)])
        doc = [rng.choice("abcd") for _ in range(120)]
        best = max(SequenceMatcher(None, doc, s, autojunk=False).find_longest_match().size for s in seqs)
        got = list(a.seeds([a.words.get(w, -1) for w in doc]))
        assert max((n for _, n, _ in got), default=0) == (best if best >= 6 else 0)
        for end, n, v in got:
            for k, last in a.places(v):
                assert seqs[k][last + 1 - n : last + 1] == doc[end - n : end]


def test_reach_counts_edits():
    assert reach([1, 2, 9, 4, 5], 0, 5, 1, [1, 2, 3, 4, 5], 0, 5, 2)[:2] == [2, 5]
    assert reach([1, 2, 4, 5], 0, 4, 1, [1, 2, 3, 4, 5], 0, 5, 1) == [2, 5]
    assert reach([1, 2, 8, 3, 4], 0, 5, 1, [1, 2, 3, 4], 0, 4, 1) == [2, 4]


def test_plain_and_own_wording():
    assert plain("Fro­zen &amp; <b>Ｂig</b> [x](http://y)").split() == ["frozen", "&", "big", "[x"]
    assert own_wording([ITEM, OTHER, "One.\n\nTwo."]) == [ITEM.split("\n\n")[1], OTHER.split("\n\n")[1], "One.\n\nTwo."]


def test_subjects(spark):
    topics = {"sport": "coach stadium referee playoff", "law": "tribunal plaintiff statute appeal"}
    rng = random.Random(8)

    def sentence(s):
        a, b = rng.sample(topics[s].split(), 2)
        return f"The team saw the {a} and the {b} again."

    docs, labels, want = [], [], {}
    for i in range(60):
        own = ["sport", "law"] if i % 8 == 7 else [["sport"], ["law"]][i % 2]
        text = " ".join(sentence(s) for s in own for _ in range(4)) + " Nobody objected to this."
        docs.append((i, text, "c"))
        want[i] = set(own)
        if i < 24:
            labels += [(i, s) for s in own] * 2
    docs += [(100, None, "c"), (101, "", "c"), (102, " \n", "c"), (103, "Nobody objected to this.", "c"), (104, " ".join(sentence("law") for _ in range(6)) + " " + sentence("sport"), "c"), (105, "coach " * 9000 + sentence("sport"), "c")]
    labels += [(0, "unknown"), (999, "law"), (None, "law")]
    want |= {104: {"law"}, 105: {"sport"}}
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    l = spark.createDataFrame(labels, "doc_id long, subject string")
    s = spark.createDataFrame([("sport",), ("law",), (None,)], "subject string")
    got = {}
    for doc, subject in rows(subject_areas(d, l, s)):
        got.setdefault(doc, set()).add(subject)
    assert got == want
    assert rows(subject_areas(d, l.limit(0), s)) == [] == rows(subject_areas(d.limit(0), l, s))
