import pytest

from factweave.sources import settings


@pytest.mark.parametrize(
    "document, code",
    [("{", "SD3001"), ("[]", "SD3001"), ('{"nope": 1}', "SD3002"), ('{"roots": [], "roots": []}', "SD3003"), ('{"roots": 1}', "SD3004"), ('{"maxCalls": 0}', "SD3005"), ('{"excludeCalls": ["a b"]}', "SD3014"), ('{"critical": ["x"], "excludeParticipants": ["x", "y"]}', "SD3015")],
)
def test_errors(document, code):
    with pytest.raises(settings.SettingsError, match=code):
        settings.parse(document)


def test_precedence():
    assert settings.parse("") == {}
    got = settings.resolve({"a": 1, "b": 1, "c": 1, "d": 1}, {"b": 2, "c": 2, "d": 2}, {"c": 3, "d": 3}, {"d": 4, "a": None})
    assert got == {"a": (1, "Default"), "b": (2, "File"), "c": (3, "Profile"), "d": (4, "CommandLine")}


def test_checked_in(spark, tmp_path):
    (tmp_path / "a.json").write_text('{ // note: "x"\n "A": {"B": true, "u": "http://y//z, }",}, /* no\n more */ "C": false, "D": "true",}')
    (tmp_path / "b.json").write_text("{ broken")
    got = settings.checked_in_booleans(spark, str(tmp_path), ["A:B", "C", "D", "E"]).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.key, r.value) for r in got) == [("a.json", "A:B", True), ("a.json", "C", False)]
