"""Token counts of texts with very long words."""

import random
import resource
import time

import public_tokenizers
from tokenizers import Tokenizer

from logloom.llm.token_counts import PrefixCounter

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_one_word_of_a_million_letters():
    count, plain = PrefixCounter(PATH), Tokenizer.from_file(PATH)
    rnd = random.Random(2)
    word = "".join(rnd.choice("etaoinshrdluü") for _ in range(1_000_000))
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    assert count.count(word) == len(plain.encode(word, add_special_tokens=False).ids)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_500_000 and time.time() - began < 300


def test_prefixes_inside_long_words():
    count, plain = PrefixCounter(PATH), Tokenizer.from_file(PATH)
    rnd = random.Random(4)
    text = "it's " + "".join(rnd.choice("etaoinshrdluü") for _ in range(150)) + " don't  " + "".join(rnd.choice("abc") for _ in range(90)) + "12 " + "é" * 70 + "\n" + "-" * 80
    assert count.prefixes(text) == [len(plain.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert count.truncate(text, 20) == max(i for i in range(len(text) + 1) if len(plain.encode(text[:i], add_special_tokens=False).ids) <= 20)
