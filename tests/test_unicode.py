import random
import unicodedata

from tradewind.functions.text import fix_store_name_typos, normalize_address
from tradewind.functions.unicode import MARKS, _paired, nfc


def test_nfc_equals_the_standard(evaluate):
    rng = random.Random(4)
    letters = "aAeiouUnscgzåéüñçǖṩάώΐῇᾳάιυЙйёґ1 შა-ÅΩά̈́"
    common = "̸̧̨̣̀́̂̃̄̆̈̊̌̓̔͂ͅ"
    texts = ["", "plain", "café", "café", "́x", "ẹ́", "ẹ́", "ǟ", "ა" * 50]
    for _ in range(600):
        texts.append("".join(rng.choice([rng.choice(letters), rng.choice(common), rng.choice(MARKS)]) for _ in range(rng.randint(0, 12))))
    want = [unicodedata.normalize("NFC", t) for t in texts]
    # Marks at the beginning of a text have no letter to be sorted under.
    got = evaluate(nfc, texts)
    wrong = [(ascii(t), ascii(g), ascii(w)) for t, g, w in zip(texts, got, want) if g != w and t[:1] not in MARKS]
    assert not wrong, wrong[:5]


def test_every_composed_letter_is_met_from_its_parts(evaluate):
    chars = [chr(p) for p in range(0xC0, 0x2000) if len(unicodedata.normalize("NFD", chr(p))) > 1]
    chars = [c for c in chars if all(m in MARKS for m in unicodedata.normalize("NFD", c)[1:])]
    parts = [unicodedata.normalize("NFD", c) for c in chars]
    assert len(chars) > 700
    assert evaluate(nfc, parts) == [unicodedata.normalize("NFC", c) for c in chars]


def test_null_and_use_in_names_and_addresses(evaluate):
    assert evaluate(nfc, [None]) == [None]
    assert evaluate(normalize_address, ["Rue de l'École ＃5 "]) == ["Rue de l'École #5"]
    assert evaluate(fix_store_name_typos, ["Café"]) == ["Café"]


def test_a_letter_with_one_mark_is_read_by_its_place(evaluate):
    chars = [chr(p) for p in range(0xC0, 0x2000)]
    parts = [(unicodedata.normalize("NFC", d[:-1]) + d[-1], c) for c in chars for d in [unicodedata.normalize("NFD", c)]]
    pairs = [(p, c) for p, c in parts if len(p) == 2 and p[1] in MARKS and unicodedata.normalize("NFC", c) == c]
    assert len(pairs) > 700
    assert evaluate(_paired, [p for p, _ in pairs]) == [c for _, c in pairs]
    assert evaluate(_paired, ["xა", "qu", "é", "", "é̂", "q́", "\U0001f600́"]) == [""] * 7
