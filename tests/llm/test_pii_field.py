"""The random field: its decoding by enumeration of all segmentations, and texts that its training rules did not make."""

import random

import numpy as np

from pairloom.llm import pii

#: Texts with the entities in them; every other number is none.
WRITTEN = [
    ("Rufen Sie 030 1234567 an oder schreiben Sie.", ["phone:030 1234567"]),
    ("Aus dem Ausland 0049 30 1234567 waehlen", ["phone:0049 30 1234567"]),
    ("ring 07911 123456 after six", ["phone:07911 123456"]),
    ("au 06 12 34 56 78 le matin", ["phone:06 12 34 56 78"]),
    ("au 06-12-34-56-78, merci", ["phone:06-12-34-56-78"]),
    ("Tel. 089/7654321", ["phone:089/7654321"]),
    ("her mobile is 0612345678.", ["phone:0612345678"]),
    ("the office, (555) 123-4567, is closed", ["phone:(555) 123-4567"]),
    ("fax 555-867-5309 or mail", ["phone:555-867-5309"]),
    ("call +44 20 7946 0958 today", ["phone:+44 20 7946 0958"]),
    ("call +1-202-555-0143 today", ["phone:+1-202-555-0143"]),
    ("paid with 4111 1111 1111 1111 yesterday", ["card:4111 1111 1111 1111"]),
    ("paid with 5500-0000-0000-0004 yesterday", ["card:5500-0000-0000-0004"]),
    ("server 192.168.10.12 is down", ["ip:192.168.10.12"]),
    ("write to anna.k@mail.example.org soon", ["email:anna.k@mail.example.org"]),
    ("measured on 2024-01-15 10 times", []),
    ("log of 2024-01-15 10:30:00 follows", []),
    ("am 15.01.2024 10.30 Uhr", []),
    ("born 12.03.1999 12.04.2000 and later", []),
    ("from 12/03/1999 to 01/04/2001 we met", []),
    ("ISBN 978-3-16-148410-0, second edition", []),
    ("isbn 9783161484100 in stock", []),
    ("see pp. 101-110 200-210 of the report", []),
    ("in 1990-2000 2000-2010 it doubled", []),
    ("some 1 234 567 890 people", []),
    ("about 12 000 000 km away", []),
    ("revenue of 1.234.567.890 euro", []),
    ("IBAN DE89 3704 0044 0532 0130 00 please", []),
    ("count 3 4 5 6 7 8 9 10 and stop", []),
    ("numbers 2 3 4 5 6 7 8 9 here", []),
    ("won 21-17 18-21 21-19 at last", []),
    ("at 52.5200 13.4050 on the map", []),
    ("invoice 2024/000123 is open", []),
    ("order 12345678 has left", []),
    ("pi is 3.14159265 or so", []),
    ("trains at 10:15 11:20 12:25", []),
    ("the card 4111 1111 1111 1112 was refused", []),
    ("version 10.20.300.4 is out", []),
    ("ISSN 2049-3630 is a journal", []),
    ("rows 17 23 5 88 41 9 62 of the table", []),
]


def test_texts_that_the_rules_did_not_make():
    w, t = pii.weights()
    right = found = known = 0
    wrong = []
    for text, want in WRITTEN:
        got = {f"{k}:{text[a:b]}" for k, a, b in pii.find(text, w, t)[1]}
        right, found, known = right + len(got & set(want)), found + len(got), known + len(want)
        if got != set(want):
            wrong.append((text, got))
    assert right / found >= 0.9 and right / known >= 0.9, wrong


def test_a_card_that_fails_its_check_is_none():
    w, t = pii.weights()
    r = random.Random(8)
    for _ in range(300):
        text = "x " + r.choice(" -./").join("".join(r.choice("0123456789") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 6))) + " y"
        for kind, a, b in pii.find(text, w, t)[1]:
            assert kind != "card" or pii.card_like(text[a:b])


def _segmentations(lat, at=0):
    """All ways to cut the tokens into other text and candidates of a kind: (i, j, label) each."""
    if at == len(lat.tokens):
        yield []
        return
    for rest in _segmentations(lat, at + 1):
        yield [(at, at + 1, 0), *rest]
    for i, j in lat.spans:
        if i == at:
            for rest in _segmentations(lat, j):
                for y in range(1, len(pii.LABELS)):
                    yield [(i, j, y), *rest]


def test_decoding_finds_the_best_of_all_segmentations():
    w, t = pii.weights()
    r, seen = random.Random(9), 0
    pieces = ["a@b.c", "12", "34567", "+4", "(", " ", "-", "x", ".", "890123", "4111111111111111"]
    while seen < 60:
        text = "".join(r.choice(pieces) for _ in range(r.randint(2, 6)))
        lat = pii.Lattice(text, 0, len(text))
        if not lat.spans or len(lat.spans) > 7 or len(lat.tokens) > 9:
            continue
        seen += 1
        s, o = lat.scores(w)
        index = {span: k for k, span in enumerate(lat.spans)}
        best, value = None, -np.inf
        for cut in _segmentations(lat):
            label, total = 0, 0.0
            for i, j, y in cut:
                total += t[label, y] + (s[index[i, j], y] if y else o[i])
                label = y
            if total > value:
                best, value = cut, total
        want = [(pii.LABELS[y], lat.tokens[i][0], lat.tokens[j - 1][1]) for i, j, y in best if y]
        assert pii.decode(lat, w, t) == want
