"""Snippets fold each letter once, and place matches where letters fold to none or several."""

from sievework.functions import passages


def test_letters_are_folded_once(monkeypatch):
    calls = []
    normalize = passages.normalize
    monkeypatch.setattr(passages, "normalize", lambda text: calls.append(text) or normalize(text))
    text = "Der Fluß fließt über Café und Wald. " * 500
    assert passages.snippet(text, ["fluß", "cafe", "wald", "zzz"]).startswith("Der «Fluß» fließt über «Café» und «Wald».")
    assert len(calls) < 100


def test_places_where_letters_fold_to_none_or_several():
    text = "a­b ﬁne été №5 ﬁ"
    assert [text[a:b] for a, b in passages.spans("ete", text)] == ["été"]
    assert passages.spans("fine", text) == [(4, 7)] and passages.spans("ab", text) == [(0, 3)]
    assert passages.spans("fi", text) == [(len(text) - 1, len(text))] and passages.spans("", text) == []
