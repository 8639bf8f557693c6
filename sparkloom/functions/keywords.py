"""Keyword tables and classifiers over lower-cased names; where several words match, the first in the list wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EFFECTS = (
    "print println eprint eprintln console log warn error debug trace info read write open close create remove delete rename copy seek flush read_to write_all read_file write_file read_dir metadata canonicalize "
    "send recv connect listen accept bind request fetch http https tcp udp socket tls websocket grpc query execute insert update drop commit rollback transaction database db pool connection migrate "
    "spawn thread fork exec process command kill wait join channel mpsc broadcast lock mutex rwlock atomic arc rc cell refcell lazy once sleep timeout interval timer now elapsed env var set_var args stdin stdout stderr "
    "unsafe extern ffi c_str from_raw into_raw serialize deserialize encode decode to_json from_json to_string parse"
).split()
ERRORS = {
    "error_creation": "error err panic throw exception fail abort bail fatal critical".split(),
    "error_handling": "catch except handle recover rescue trap on_error on_panic guard".split(),
    "error_propagation": "unwrap expect propagate bail raise rethrow try question_mark ok_or map_err or_else and_then".split(),
    "error_types": "result option none some ok err error failure try either".split(),
}
LIFECYCLE = {
    "creation": "new init create open acquire connect build start setup begin alloc allocate".split(),
    "cleanup": "close drop release unlock free destroy cleanup clear reset flush shutdown stop end finish dealloc dispose remove delete".split(),
    "usage": "get read write update set put push append insert send recv fetch load process execute run call invoke lock hold use access query find search filter map iter".split(),
}
GENERIC = "new init create get set run start stop handle process update delete add remove find list load save".split()
IO_CALLEES = "get post put delete patch head options send recv connect listen accept read write open close execute query invoke call dispatch".split()
CONFIG = "config env setting feature flag var option param pref secret token key credential password api_key".split()
CONCURRENCY = "lock mutex atomic thread spawn async await channel arc sync concurrent parallel rwlock semaphore barrier condvar lazy_static once_cell tokio smol executor worker pool queue".split()
ENV_CALLEES = "env var set_var remove_var vars env_var get_env set_env read_env std::env::var std::env::set_var std::env::vars dotenv dotenv_var from_env env_logger config load_config read_config parse_config from_str try_from_env".split()
READER_CALLEES = "read_to_string read open File::open from_reader from_path load parse toml serde_json serde_yaml serde_toml ConfigBuilder Config Environment configparser ConfigParser load_dotenv".split()
ASYNC_CALLEES = "block_on spawn_blocking yield_now sleep timeout".split()
SHARED_CALLEES = "Arc Rc Mutex RwLock Cell RefCell lock read write try_lock get_mut".split()
TEST_FRAMEWORK = "test expect assert describe it( jest mocha pytest runner".split()
PRIVATE = "_internal _private _impl Internal Private".split()


def first_word(name: Column, words: list[str]) -> Column:
    """The first word of the list that the lower-cased name contains, or null."""
    low = F.lower(name)  # a filter over a constant array: one branch for each word would outgrow generated code
    return F.get(F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(w)), 0)


def first_class(name: Column, classes: dict[str, list[str]]) -> Column:
    return F.coalesce(*(F.when(first_word(name, words).isNotNull(), F.lit(c)) for c, words in classes.items()))


def any_word(name: Column, words: list[str]) -> Column:
    return F.coalesce(first_word(name, words).isNotNull(), F.lit(False))


def is_test_path(path: Column) -> Column:
    return path.rlike(r"test|spec|__tests__|(_test\.(rs|py|ts|js|go|java)|\.(test|spec)\.(ts|js))$")


def is_test_name(name: Column) -> Column:
    return name.rlike(r"test|Test|Spec|should_|^it_|_spec$")


def is_private_name(name: Column) -> Column:
    return (name.startswith("_") & ~name.startswith("__")) | F.coalesce(name.rlike("|".join(PRIVATE)), F.lit(False))


def sql_any(column: str, words: list[str]) -> str:
    """The SQL form of ``any_word``."""
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


def sql_first(column: str, words: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({column}), '{w}') THEN '{w}'" for w in words) + " END"


def sql_class(column: str, classes: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {sql_any(column, w)} THEN '{c}'" for c, w in classes.items()) + " END"
