import random

import pytest

from hashgrove.llm import decontamination

SIZES = (60, 96, 97, 145, 400, 3000)


def words(r, n):
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n)]


@pytest.mark.parametrize("answer", [3, 12])
def test_items_of_any_length_need_question_and_answer(answer):
    r = random.Random(answer)
    parts = {n: (words(r, n - answer), words(r, answer)) for n in SIZES}
    index = decontamination.Index([(n, " ".join(q) + ". " + " ".join(a) + ".") for n, (q, a) in parts.items()])
    for n, (q, a) in parts.items():
        around = lambda *x: " ".join([*words(r, 250), *(w for y in x for w in y), *words(r, 330)]).encode()
        most = q[len(q) * 3 // 10 :]
        held = [around(q, a), " ".join([*q, *a]).encode(), around(most, a), around(q, words(r, 5), a)]
        free = [around(q), around(a), around(q[:48]), around(q[-30:], a) if n > 96 else around(a), around(words(r, 700)), b""]
        got = [[x[0] for x in hits] for hits in index.search(held + free)]
        assert got == [[n]] * len(held) + [[]] * len(free), n
