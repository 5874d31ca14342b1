import random
import re

from pairloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(s):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(s)]
    out += [("ip", *m.span()) for m in IP.finditer(s) if all(int(q) <= 255 for q in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(s) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(s) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_patterns_against_plain_expressions():
    r = random.Random(1)
    for _ in range(20_000):
        s = "".join(r.choice("a1.@-+ ()52é") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(s) == brute(s)


def test_held_out_examples_and_long_texts():
    w, t = pii.weights()
    wrong = sum(set(pii.find(text, w, t)[1]) != set(spans) for text, spans in pii.examples(150, 99))
    assert wrong <= 3
    for text in ("1" * 200_000, "a" * 200_000 + "@b.c", "1." * 50_000, "+1 " * 50_000, "a@" * 50_000):
        pii.base_spans(text)
    assert pii.find("é call 4111111111111111 4012888888881881 now", w, t)[1] == [("card", 7, 23), ("card", 24, 40)]


def test_detect_and_redact(spark):
    rows = [(1, "mail bob.34@mail7.example.com now", "x"), (2, None, "x"), (3, "", "x"), (None, "ip 10.20.30.40.", "x"), (1, "mail bob.34@mail7.example.com now", "x"), (4, "clean text 1999", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(map(str, pii.detect(docs).select("doc_id", "n_email", "n_ip", "spans").collect()))
    assert got == sorted(
        [*["Row(doc_id=1, n_email=1, n_ip=0, spans='email:5:29')"] * 2, "Row(doc_id=2, n_email=0, n_ip=0, spans='')", "Row(doc_id=3, n_email=0, n_ip=0, spans='')", "Row(doc_id=None, n_email=0, n_ip=1, spans='ip:3:14')", "Row(doc_id=4, n_email=0, n_ip=0, spans='')"]
    )
    assert [r.text for r in pii.redact(docs).collect()] == ["mail <EMAIL> now", None, "", "ip <IP>.", "mail <EMAIL> now", "clean text 1999"]
    assert pii.redact(docs).columns == docs.columns and pii.detect(docs.limit(0)).count() == 0


def test_numbers_in_pairs_whatever_stands_near():
    w, t = pii.weights()
    for number in ("06 12 34 56 78", "06-12-34-56-78"):
        for before in ("", "en 2024, ", "@home "):
            text = f"{before}appelez le {number} demain"
            a = text.index(number)
            assert ("phone", a, a + len(number)) in pii.find(text, w, t)[1]
    assert not list(pii.windows("le 12 et 34 a 56"))


def test_windows_decode_as_the_whole_text():
    w, t = pii.weights()
    address = "marie@société-générale-du-bâtiment-et-travaux.fr"
    text = f"écrivez à {address} demain"
    assert pii.find(text, w, t)[1] == [("email", 10, 10 + len(address))]
    r = random.Random(4)
    filler = ("mot ", "élan, ", "x" * 90 + " ", "a\n", "((", "n° 12, ", "- ", "\t\t", "日本語", "٣٤ ")
    parts = (address, "06 12 34 56 78", "06-12-34-56-78", "0612345678", "+33 6 12 34 56 78", "a@b", "@", "12.03.1999", "4111 1111 1111 1111", f"{'é' * 40}@{'ü' * 38}", "1" * 85, "731 ", "52 8 ")  # none so regular that shifted spans tie
    n = 0
    for _ in range(400):
        text = "".join(r.choice(filler) * r.randint(1, r.choice((2, 40))) if r.random() < 0.7 else r.choice(parts) for _ in range(r.randint(1, 12)))
        found = [s for a, b in pii.windows(text) for s in pii.decode(pii.Lattice(text, a, b), w, t)]
        assert found == pii.decode(pii.Lattice(text, 0, len(text)), w, t)
        n += len(found)
    assert n > 300
    for text in ("1" * 200_000, "é" * 200_000 + "@b.c", ("é" * 161 + "@") * 1200):
        assert all(0 <= a < b <= len(text) for a, b in pii.windows(text))
