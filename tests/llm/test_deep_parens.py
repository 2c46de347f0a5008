"""Parameter lists nested beyond the interpreter's stack."""

from codestrata.llm.docpairs import parse_pairs


def test_functions_behind_a_deep_spot_are_found():
    deep = "(" * 5000 + "1" + ")" * 5000
    py = f'def f(a={deep}):\n    """One."""\n\ndef g(a):\n    """Two."""\n'
    assert [(line, name) for line, name, _, _ in parse_pairs("py", py)] == [(1, "f"), (4, "g")]
    java = f"/** One. */\n@A({deep})\npublic void f() {{}}\n/** Two. */\npublic void g() {{}}\n"
    assert [(line, name) for line, name, _, _ in parse_pairs("java", java)] == [(3, "f"), (5, "g")]
    assert [name for _, name, _, _ in parse_pairs("py", "def f" + "(" * 5000 + '\ndef g(a):\n    """Two."""\n')] == ["g"]
