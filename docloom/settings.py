"""Settings of a workspace: severities of rules, what is checked, words, entry points."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession

from docloom.functions import text as fx

#: File names that are looked for, the first first.
NAMES = ("docloom.toml", ".docloom.toml")
#: Severities; `ignore` leaves a rule out.
SEVERITIES = ("error", "warning", "info", "ignore")


class InvalidSettings(ValueError):
    pass


@dataclass(frozen=True)
class Bridge:
    orphans: str = "warning"
    superseded_status: str = "error"


@dataclass(frozen=True)
class Plugins:
    api_docs: bool = False
    writing_quality: bool = True
    diagrams: bool = True
    custom_rules: tuple[str, ...] = ()
    custom_weasel_words: tuple[str, ...] = fx.WEASEL_WORDS


@dataclass(frozen=True)
class Place:
    root: str | None = None
    entry_points: tuple[str, ...] = ("index.adoc", "README.adoc")


@dataclass(frozen=True)
class Settings:
    bridge: Bridge = field(default_factory=Bridge)
    plugins: Plugins = field(default_factory=Plugins)
    workspace: Place = field(default_factory=Place)


def _section(kind: type, given: object, where: str):
    if not isinstance(given, dict):
        raise InvalidSettings(f"{where}: a table is expected")
    known = {f.name: f for f in fields(kind)}
    own = {}
    for name, value in given.items():
        if name not in known:
            continue  # settings of other tools and versions
        default = getattr(kind(), name)
        if isinstance(default, tuple):
            if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
                raise InvalidSettings(f"{where}.{name}: a list of strings is expected")
            value = tuple(value)
        elif isinstance(default, bool) != isinstance(value, bool) or not isinstance(value, (str, bool)):
            raise InvalidSettings(f"{where}.{name}: {'true or false' if isinstance(default, bool) else 'a string'} is expected")
        if kind is Bridge and value not in SEVERITIES:
            raise InvalidSettings(f"{where}.{name}: one of {', '.join(SEVERITIES)} is expected")
        own[name] = value
    return kind(**own)


def from_table(table: dict) -> Settings:
    """Settings from nested tables; what is not given keeps its default, unknown keys are passed over."""
    return Settings(_section(Bridge, table.get("compliance", {}).get("bridge", {}) if isinstance(table.get("compliance", {}), dict) else table["compliance"], "compliance.bridge"), _section(Plugins, table.get("plugins", {}), "plugins"), _section(Place, table.get("workspace", {}), "workspace"))


def from_toml(text: str) -> Settings:
    try:
        return from_table(tomllib.loads(text))
    except tomllib.TOMLDecodeError as e:
        raise InvalidSettings(str(e)) from e


def _read(spark: SparkSession, path: str) -> str | None:
    """A small file's text from whatever store Spark can read, hidden names too; None where
    there is none."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at):
        return None
    stream = store.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def load(spark: SparkSession, path: str | None = None, folder: str = ".", names: tuple[str, ...] = NAMES) -> Settings:
    """The settings of a file that has to be there and has to be right, or, without one, of
    the first well-formed file of a folder that bears one of `names`, else the defaults."""
    if path is not None:
        text = _read(spark, path)
        if text is None:
            raise FileNotFoundError(path)
        return from_toml(text)
    for name in names:
        text = _read(spark, f"{folder.rstrip('/')}/{name}")
        if text is not None:
            try:
                return from_toml(text)
            except InvalidSettings:
                pass
    return Settings()


def severity(value: str) -> str | None:
    """What a registry takes: None where a rule is left out."""
    return None if value == "ignore" else value
