import datetime
import json
import random

import pytest

from quillon.functions import dialect as d


def canon(text):
    return d.dump(d.parse(text))


@pytest.mark.parametrize("text,want", [
    ('{"oak":7,,"elm":[8,9,],}', '{"oak":7,"elm":[8,9]}'),
    ('{"oak":{"elm":[8,9', '{"oak":{"elm":[8,9]}}'),
    ('{"oak":7,"elm":8,"oak":9}', '{"oak":9,"elm":8}'),
    ("null", "null"), (" [ null ] ", "[null]"), ("", None), ("?? ;; ??", None), (None, None),
    ("[/b{2}/m, 4]", "[/b{2}/m,4]"), ('{"rule":/q/}', '{"rule":/q/}'),
    ("[6, -7, 0, 6.25, -0.75]", "[6,-7,0,6.25,-0.75]"),
    ('["o\\u0308","\\t\\f"]', '["o\u0308","\\t\\f"]'),
    ("[zzfalse,maybe,true]", "[false,true]"), ("[1e3,4]", "[4]"), ("12345678901234567890", None), ('"\\ud800x"', '"�x"'), ("[NaN,3]", "[3]"),
])
def test_reads_leniently(text, want):
    assert canon(text) == want


def test_garbage_never_fails():
    rnd = random.Random(1)
    for _ in range(300):
        d.dump(d.parse(bytes(rnd.choice(b'{}[]",:/\\ truefalsn01.e\x00\xff') for _ in range(60))))


def value(rnd, deep):
    kind = rnd.randrange(5 if deep <= 0 else 8)
    if kind < 4:
        return [None, rnd.random() < 0.5, rnd.randrange(-(10**6), 10**6), rnd.choice([0.5, 1e-7, -2.25, 1e20, 0.001, -0.0])][kind]
    if kind == 4:
        return "".join(rnd.choice('aé"\\\n\t/{}[]:,\x01 💥') for _ in range(rnd.randrange(6)))
    if kind < 6:
        return [value(rnd, deep - 1) for _ in range(rnd.randrange(4))]
    return {"".join(rnd.choice('ab"\\:') for _ in range(3)): value(rnd, deep - 1) for _ in range(rnd.randrange(4))}


def test_both_readers_agree_on_strict_text():
    rnd = random.Random(2)
    for _ in range(2000):
        text = json.dumps(value(rnd, 4), ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 1]))
        tree = d.parse(text)
        assert d.same(tree, d.parse(text.encode())), text
        assert d.dump(d.parse(d.dump(tree))) == d.dump(tree)


def test_deep_texts_need_no_recursion():
    text = "[" * 50_000 + "]" * 50_000
    assert canon(text) == text
    assert d.dump(d.sort_all(d.parse('{"a":' * 2000 + "1" + "}" * 2000))) == '{"a":' * 2000 + "1" + "}" * 2000


def test_shortlex_sorting():
    assert d.dump(d.sort_keys(d.parse('{"maple":1,"fig":2,"ash":3,"willow":4}'))) == '{"ash":3,"fig":2,"maple":1,"willow":4}'
    assert d.dump(d.sort_all(d.parse('{"tall":[70,8,600],"low":{}}'))) == '{"low":{},"tall":[8,70,600]}'


def test_equality_is_by_type_and_order():
    assert not d.same(4, 4.0) and not d.same(1, True) and d.same(0.0, -0.0)
    assert not d.same({"x": 5, "y": 6}, {"y": 6, "x": 5})
    assert d.same([5, {"x": None}], [5, {"x": None}]) and not d.same(d.Regex("/x/"), "/x/")


def test_pretty():
    assert d.dump(d.parse('{"k":[5],"l":{},"m":[]}'), pretty=True) == '{\n    "k": [\n        5\n    ],\n    "l": {},\n    "m": []\n}'


def test_python_values():
    class Own:
        def to_document(self):
            return [1, datetime.datetime(2020, 1, 2, 3, 4, 5)]

    class Other:
        pass

    assert d.from_python({"o": Own(), "x": Other(), 3: 4}) == {"o": [1, "2020-01-02T03:04:05Z"], "x": None}
    with pytest.raises(TypeError):
        d.from_python(Other())
    d.register_conversion(Other, lambda _: "other")
    assert d.from_python(Other()) == "other"
    assert d.reify({"a": [None, d.Regex("/x/")]}, null=0) == {"a": [0, "/x/"]}
