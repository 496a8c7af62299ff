import copy

import pytest

from curatrix.config import ConfigError, parse


@pytest.fixture
def raw(tmp_path):
    (tmp_path / "library").mkdir()
    (tmp_path / "references").mkdir()
    return {
        "paths": {"library": "library", "references": "references"},
        "recognition": {"threshold": 0.45, "max_side": 1280, "threads": 4, "skip_invalid_references": True},
        "selection": {"top": 30, "minimum_score": 6.0, "near_duplicate_distance": 6, "diversity_bonus": 0.75, "not_before": ""},
        "vision": {"image_size": 1008, "timeout_seconds": 180, "exclude": ["a rule"]},
        "criteria": {"pose": {"weight": 2.0, "description": "d"}, "light": {"weight": 1, "description": "e"}},
    }


def test_defaults_and_signature(raw, tmp_path):
    config = parse(copy.deepcopy(raw), tmp_path)
    assert (config.selection.max_per_day, config.selection.min_visual_distance) == (1, 12)
    other = copy.deepcopy(raw)
    other["criteria"]["pose"]["weight"] = 9.0
    other["selection"]["top"] = 3
    assert parse(other, tmp_path).signature() == config.signature()
    other["criteria"]["pose"]["description"] = "another"
    assert parse(other, tmp_path).signature() != config.signature()


@pytest.mark.parametrize("change", [
    ("selection", "top", 0), ("selection", "top", True), ("selection", "top", 2.0), ("selection", "not_before", 0), ("selection", "not_before", "soon"),
    ("selection", "max_per_day", -1), ("selection", "min_visual_distance", 65), ("recognition", "threshold", float("nan")), ("recognition", "max_side", 1281),
    ("recognition", "skip_invalid_references", 1), ("vision", "exclude", [" "]), ("vision", "exclude", "x"), ("criteria", "pose", {"weight": -1, "description": "d"}),
    ("criteria", "Bad", {"weight": 1, "description": "d"}), ("criteria", "pose", {"weight": 1, "description": " "}), ("paths", "library", "${NOT_SET_HERE}"),
    ("paths", "library", "nowhere"), ("vision", "more", 1),
])
def test_mistakes_are_named(raw, tmp_path, change):
    section, key, value = change
    raw[section][key] = value
    with pytest.raises(ConfigError):
        parse(raw, tmp_path)


def test_sections_and_weights(raw, tmp_path):
    for wrong in ({**raw, "more": {}}, {k: v for k, v in raw.items() if k != "vision"}, {**raw, "criteria": {"pose": {"weight": 0, "description": "d"}}}):
        with pytest.raises(ConfigError):
            parse(wrong, tmp_path)
