"""Attack flags of packets under the labelling modes of a capture."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from railtap.functions.coerce import safe_int_offline
from railtap.functions.scalars import hex_word, is_all_zero, normalized_hex

# The watched variable, its expected head word, the write function and commands.
WATCHED_VARIABLE = "%DB001046"
EXPECTED_HEAD = "0500"
WRITE_REGISTER = 6
WRITE_COMMANDS = (0x58, 0x59)
LAST_WORD, MIDDLE_WORD = 5, 4

# Labelling modes and the file-name marks that select them, first match wins.
MODES = ("modbus_fc6", "xgt_last_zero", "xgt_mid_zero", "xgt_head_zero",
         "xgt_write_or_fc6", "xgt_write_or_fc6_after")
MODE_ALIASES = {"xgt_d528_zero": "xgt_last_zero", "xgt_d525_zero": "xgt_mid_zero"}
FILE_MARKS = (("ver5_2", "xgt_head_zero"), ("ver5_1", "xgt_mid_zero"), ("ver5", "xgt_last_zero"),
              ("ver2", "xgt_write_or_fc6"), ("ver11", "xgt_write_or_fc6"), ("attack", "xgt_write_or_fc6"))
DEFAULT_MODE = "modbus_fc6"


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def register_write(protocol: Column, fc: Column) -> Column:
    """Modbus write to a register (function 6)."""
    return _no((protocol == "modbus") & (safe_int_offline(fc, -1) == WRITE_REGISTER))


def command_write(protocol: Column, cmd: Column) -> Column:
    """XGT write command."""
    return _no((protocol == "xgt_fen") & safe_int_offline(cmd, -1).isin(*WRITE_COMMANDS))


def _watched(protocol: Column, variables: Column, data: Column, least: int) -> Column:
    text = normalized_hex(data)
    return _no((protocol == "xgt_fen") & (variables == WATCHED_VARIABLE) & (text != "")
               & ~is_all_zero(text) & (F.length(text) >= least))


def word_zero(protocol: Column, variables: Column, data: Column, index: int) -> Column:
    """Word ``index`` of the watched variable is zero although the payload is not all zero."""
    return (_watched(protocol, variables, data, 4 * index + 4)
            & (hex_word(normalized_hex(data), index) == "0000"))


def head_anomaly(protocol: Column, variables: Column, data: Column) -> Column:
    """First word of the watched variable differs from its expected value."""
    return (_watched(protocol, variables, data, 4)
            & (hex_word(normalized_hex(data), 0) != EXPECTED_HEAD))


def mode_from_file(path: Column) -> Column:
    """Labelling mode by the source file's name."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    mode = F.when(F.lit(False), F.lit(None).cast("string"))
    for mark, m in FILE_MARKS:
        mode = mode.when(name.contains(mark), m)
    return mode.otherwise(DEFAULT_MODE)


def resolve_mode(mode: Column, path: Column) -> Column:
    """``auto`` is taken from the file name, alias modes map to their canonical name."""
    out = F.when(mode == "auto", mode_from_file(path))
    for alias, m in MODE_ALIASES.items():
        out = out.when(mode == alias, m)
    return out.otherwise(mode)


def attack_flag(mode: Column, protocol: Column, fc: Column, cmd: Column, variables: Column,
                data: Column) -> Column:
    """Attack flag of a packet; a write command is one in every mode, unknown modes add nothing."""
    fc6 = register_write(protocol, fc)
    head = head_anomaly(protocol, variables, data)
    by_mode = (F.when(mode.isin("modbus_fc6", "xgt_write_or_fc6"), fc6)
               .when(mode == "xgt_last_zero", word_zero(protocol, variables, data, LAST_WORD))
               .when(mode == "xgt_mid_zero", word_zero(protocol, variables, data, MIDDLE_WORD))
               .when(mode == "xgt_head_zero", head)
               .when(mode == "xgt_write_or_fc6_after", fc6 | head)
               .otherwise(F.lit(False)))
    return command_write(protocol, cmd) | by_mode
