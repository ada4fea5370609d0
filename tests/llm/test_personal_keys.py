"""Addresses without digits."""

import random

from infosieve.llm import pii


def test_keys_need_no_digit():
    assert pii.keys("jane.doe@example.com") == {"jane.doe@example.com", "jane.doe"}
    assert pii.keys("<Jane.Doe@example>,") == {"jane.doe@example", "jane.doe"}
    assert len(pii.keys("und.34@mail7.example.com")) == 2


def graph_of(text):
    graph = pii.Graph()
    graph.add(0, text, pii.base_spans(text))
    return graph, [text[a:z] for a, z in graph.spans]


def test_repeats_of_an_address_without_a_digit_take_part():
    graph, words = graph_of("write to jane.doe@example.com " + "plain words go on " * 10 + "then ask (jane.doe) or jane.doe@example now")
    at = [words.index(w) for w in ("jane.doe@example.com", "(jane.doe)", "jane.doe@example")]
    assert {(at[0], at[1]), (at[1], at[2])} <= {tuple(e) for e in graph.arrays()[3].tolist()}
    assert "plain" in words and words.count("plain") == 1  # only next to the address
    assert not graph_of("write words 12 write words 12")[0].skip


def test_broken_mentions_without_digits_are_labelled_alike():
    rng = random.Random(5)
    graph, field = pii.Graph(), pii.Field()
    for i in range(300):
        mail = "".join(rng.choices("abcdefgh", k=8)) + "@mail.example.com"
        t = f"write to {mail} " + "the plain words go on " * 10 + f"again {mail} or not 12 of {rng.randint(1, 99)}"
        graph.add(i, t, pii.base_spans(t))
    field.fit(graph)
    far, near = "write to bcadfeha@mail.example.com " + "the plain words go on " * 10, "again bcadfeha@mail or not 12 of 33"
    got = []
    for text in (far + near, near):
        probe, words = graph_of(text)
        got.append(field.marginals(probe)[words.index("bcadfeha@mail"), 1])
    assert got[0] > got[1] and got[0] > 0.5


def test_long_zeros_in_addresses(spark):
    """A part of thousands of zeros is the number 0."""
    text = f"at {'0' * 5000}.1.1.1 and 1.{'0' * 4400}7.2.3 not 1.2.3.{'0' * 9}256"
    (r,) = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r["n_ip"] == 2
