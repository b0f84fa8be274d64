import pytest

from threadmill.sources.config import Config


def test_missing_file_gives_defaults(tmp_path):
    assert Config.load(tmp_path / "none.toml") == Config()


def test_round_trip_and_types(tmp_path):
    config = Config()
    config.set("api.key", 'a "quoted" \\ key')
    config.set("api.embedding_dims", "768")
    config.set("search.use_graph", "false")
    config.save(tmp_path / "c.toml")
    again = Config.load(tmp_path / "c.toml")
    assert again == config and again.api.embedding_dims == 768 and again.search.use_graph is False


def test_wrong_names_and_values():
    config = Config()
    for name, value, error in (("api.nothing", 1, KeyError), ("nowhere.key", 1, KeyError), ("api.embedding_dims", "many", ValueError), ("search.use_graph", "perhaps", ValueError)):
        with pytest.raises(error):
            config.set(name, value)
