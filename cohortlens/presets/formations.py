"""Formation templates and generic line roles as rows."""

from __future__ import annotations

# Fixed values: (formation, line from defence to attack, players in the line, place from
# low to high grid column, role).
TEMPLATES = (
    ("4-3-3", 1, 4, 1, "LB"),
    ("4-3-3", 1, 4, 2, "LCB"),
    ("4-3-3", 1, 4, 3, "RCB"),
    ("4-3-3", 1, 4, 4, "RB"),
    ("4-3-3", 2, 3, 1, "CM"),
    ("4-3-3", 2, 3, 2, "DM"),
    ("4-3-3", 2, 3, 3, "CM"),
    ("4-3-3", 3, 3, 1, "LW"),
    ("4-3-3", 3, 3, 2, "ST"),
    ("4-3-3", 3, 3, 3, "RW"),
    ("4-2-3-1", 1, 4, 1, "LB"),
    ("4-2-3-1", 1, 4, 2, "LCB"),
    ("4-2-3-1", 1, 4, 3, "RCB"),
    ("4-2-3-1", 1, 4, 4, "RB"),
    ("4-2-3-1", 2, 2, 1, "DM"),
    ("4-2-3-1", 2, 2, 2, "DM"),
    ("4-2-3-1", 3, 3, 1, "LW"),
    ("4-2-3-1", 3, 3, 2, "AM"),
    ("4-2-3-1", 3, 3, 3, "RW"),
    ("4-2-3-1", 4, 1, 1, "ST"),
    ("4-1-4-1", 1, 4, 1, "LB"),
    ("4-1-4-1", 1, 4, 2, "LCB"),
    ("4-1-4-1", 1, 4, 3, "RCB"),
    ("4-1-4-1", 1, 4, 4, "RB"),
    ("4-1-4-1", 2, 1, 1, "DM"),
    ("4-1-4-1", 3, 4, 1, "LW"),
    ("4-1-4-1", 3, 4, 2, "CM"),
    ("4-1-4-1", 3, 4, 3, "CM"),
    ("4-1-4-1", 3, 4, 4, "RW"),
    ("4-1-4-1", 4, 1, 1, "ST"),
    ("4-4-2", 1, 4, 1, "LB"),
    ("4-4-2", 1, 4, 2, "LCB"),
    ("4-4-2", 1, 4, 3, "RCB"),
    ("4-4-2", 1, 4, 4, "RB"),
    ("4-4-2", 2, 4, 1, "LW"),
    ("4-4-2", 2, 4, 2, "CM"),
    ("4-4-2", 2, 4, 3, "CM"),
    ("4-4-2", 2, 4, 4, "RW"),
    ("4-4-2", 3, 2, 1, "ST"),
    ("4-4-2", 3, 2, 2, "ST"),
    ("4-3-1-2", 1, 4, 1, "LB"),
    ("4-3-1-2", 1, 4, 2, "LCB"),
    ("4-3-1-2", 1, 4, 3, "RCB"),
    ("4-3-1-2", 1, 4, 4, "RB"),
    ("4-3-1-2", 2, 3, 1, "CM"),
    ("4-3-1-2", 2, 3, 2, "DM"),
    ("4-3-1-2", 2, 3, 3, "CM"),
    ("4-3-1-2", 3, 1, 1, "AM"),
    ("4-3-1-2", 4, 2, 1, "ST"),
    ("4-3-1-2", 4, 2, 2, "ST"),
    ("4-2-2-2", 1, 4, 1, "LB"),
    ("4-2-2-2", 1, 4, 2, "LCB"),
    ("4-2-2-2", 1, 4, 3, "RCB"),
    ("4-2-2-2", 1, 4, 4, "RB"),
    ("4-2-2-2", 2, 2, 1, "DM"),
    ("4-2-2-2", 2, 2, 2, "DM"),
    ("4-2-2-2", 3, 2, 1, "AM"),
    ("4-2-2-2", 3, 2, 2, "AM"),
    ("4-2-2-2", 4, 2, 1, "ST"),
    ("4-2-2-2", 4, 2, 2, "ST"),
    ("4-2-4", 1, 4, 1, "LB"),
    ("4-2-4", 1, 4, 2, "LCB"),
    ("4-2-4", 1, 4, 3, "RCB"),
    ("4-2-4", 1, 4, 4, "RB"),
    ("4-2-4", 2, 2, 1, "DM"),
    ("4-2-4", 2, 2, 2, "CM"),
    ("4-2-4", 3, 4, 1, "LW"),
    ("4-2-4", 3, 4, 2, "ST"),
    ("4-2-4", 3, 4, 3, "ST"),
    ("4-2-4", 3, 4, 4, "RW"),
    ("4-1-2-3", 1, 4, 1, "LB"),
    ("4-1-2-3", 1, 4, 2, "LCB"),
    ("4-1-2-3", 1, 4, 3, "RCB"),
    ("4-1-2-3", 1, 4, 4, "RB"),
    ("4-1-2-3", 2, 1, 1, "DM"),
    ("4-1-2-3", 3, 2, 1, "CM"),
    ("4-1-2-3", 3, 2, 2, "CM"),
    ("4-1-2-3", 4, 3, 1, "LW"),
    ("4-1-2-3", 4, 3, 2, "ST"),
    ("4-1-2-3", 4, 3, 3, "RW"),
    ("3-5-2", 1, 3, 1, "LCB"),
    ("3-5-2", 1, 3, 2, "CB"),
    ("3-5-2", 1, 3, 3, "RCB"),
    ("3-5-2", 2, 5, 1, "LB"),
    ("3-5-2", 2, 5, 2, "CM"),
    ("3-5-2", 2, 5, 3, "DM"),
    ("3-5-2", 2, 5, 4, "CM"),
    ("3-5-2", 2, 5, 5, "RB"),
    ("3-5-2", 3, 2, 1, "ST"),
    ("3-5-2", 3, 2, 2, "ST"),
    ("3-4-2-1", 1, 3, 1, "LCB"),
    ("3-4-2-1", 1, 3, 2, "CB"),
    ("3-4-2-1", 1, 3, 3, "RCB"),
    ("3-4-2-1", 2, 4, 1, "LB"),
    ("3-4-2-1", 2, 4, 2, "CM"),
    ("3-4-2-1", 2, 4, 3, "CM"),
    ("3-4-2-1", 2, 4, 4, "RB"),
    ("3-4-2-1", 3, 2, 1, "AM"),
    ("3-4-2-1", 3, 2, 2, "AM"),
    ("3-4-2-1", 4, 1, 1, "ST"),
    ("3-4-1-2", 1, 3, 1, "LCB"),
    ("3-4-1-2", 1, 3, 2, "CB"),
    ("3-4-1-2", 1, 3, 3, "RCB"),
    ("3-4-1-2", 2, 4, 1, "LB"),
    ("3-4-1-2", 2, 4, 2, "CM"),
    ("3-4-1-2", 2, 4, 3, "CM"),
    ("3-4-1-2", 2, 4, 4, "RB"),
    ("3-4-1-2", 3, 1, 1, "AM"),
    ("3-4-1-2", 4, 2, 1, "ST"),
    ("3-4-1-2", 4, 2, 2, "ST"),
    ("3-4-3", 1, 3, 1, "LCB"),
    ("3-4-3", 1, 3, 2, "CB"),
    ("3-4-3", 1, 3, 3, "RCB"),
    ("3-4-3", 2, 4, 1, "LB"),
    ("3-4-3", 2, 4, 2, "CM"),
    ("3-4-3", 2, 4, 3, "CM"),
    ("3-4-3", 2, 4, 4, "RB"),
    ("3-4-3", 3, 3, 1, "LW"),
    ("3-4-3", 3, 3, 2, "ST"),
    ("3-4-3", 3, 3, 3, "RW"),
    ("5-3-2", 1, 5, 1, "LB"),
    ("5-3-2", 1, 5, 2, "LCB"),
    ("5-3-2", 1, 5, 3, "CB"),
    ("5-3-2", 1, 5, 4, "RCB"),
    ("5-3-2", 1, 5, 5, "RB"),
    ("5-3-2", 2, 3, 1, "CM"),
    ("5-3-2", 2, 3, 2, "DM"),
    ("5-3-2", 2, 3, 3, "CM"),
    ("5-3-2", 3, 2, 1, "ST"),
    ("5-3-2", 3, 2, 2, "ST"),
    ("5-4-1", 1, 5, 1, "LB"),
    ("5-4-1", 1, 5, 2, "LCB"),
    ("5-4-1", 1, 5, 3, "CB"),
    ("5-4-1", 1, 5, 4, "RCB"),
    ("5-4-1", 1, 5, 5, "RB"),
    ("5-4-1", 2, 4, 1, "LW"),
    ("5-4-1", 2, 4, 2, "CM"),
    ("5-4-1", 2, 4, 3, "CM"),
    ("5-4-1", 2, 4, 4, "RW"),
    ("5-4-1", 3, 1, 1, "ST"),
    ("4-5-1", 1, 4, 1, "LB"),
    ("4-5-1", 1, 4, 2, "LCB"),
    ("4-5-1", 1, 4, 3, "RCB"),
    ("4-5-1", 1, 4, 4, "RB"),
    ("4-5-1", 2, 5, 1, "LW"),
    ("4-5-1", 2, 5, 2, "CM"),
    ("4-5-1", 2, 5, 3, "DM"),
    ("4-5-1", 2, 5, 4, "CM"),
    ("4-5-1", 2, 5, 5, "RW"),
    ("4-5-1", 3, 1, 1, "ST"),
)

# Roles of a line by its kind when no template fits, as (kind, players in
# the line, place, role).
GENERIC = (
    ("first", 2, 1, "LCB"),
    ("first", 2, 2, "RCB"),
    ("first", 3, 1, "LCB"),
    ("first", 3, 2, "CB"),
    ("first", 3, 3, "RCB"),
    ("first", 4, 1, "LB"),
    ("first", 4, 2, "LCB"),
    ("first", 4, 3, "RCB"),
    ("first", 4, 4, "RB"),
    ("first", 5, 1, "LB"),
    ("first", 5, 2, "LCB"),
    ("first", 5, 3, "CB"),
    ("first", 5, 4, "RCB"),
    ("first", 5, 5, "RB"),
    ("last", 1, 1, "ST"),
    ("last", 2, 1, "ST"),
    ("last", 2, 2, "ST"),
    ("last", 3, 1, "LW"),
    ("last", 3, 2, "ST"),
    ("last", 3, 3, "RW"),
    ("last", 4, 1, "LW"),
    ("last", 4, 2, "ST"),
    ("last", 4, 3, "ST"),
    ("last", 4, 4, "RW"),
    ("wing", 4, 1, "LB"),
    ("wing", 4, 2, "CM"),
    ("wing", 4, 3, "CM"),
    ("wing", 4, 4, "RB"),
    ("wing", 5, 1, "LB"),
    ("wing", 5, 2, "CM"),
    ("wing", 5, 3, "DM"),
    ("wing", 5, 4, "CM"),
    ("wing", 5, 5, "RB"),
    ("second", 1, 1, "DM"),
    ("second", 2, 1, "DM"),
    ("second", 2, 2, "DM"),
    ("second", 3, 1, "CM"),
    ("second", 3, 2, "DM"),
    ("second", 3, 3, "CM"),
    ("second", 4, 1, "LW"),
    ("second", 4, 2, "CM"),
    ("second", 4, 3, "CM"),
    ("second", 4, 4, "RW"),
    ("second", 5, 1, "LB"),
    ("second", 5, 2, "CM"),
    ("second", 5, 3, "DM"),
    ("second", 5, 4, "CM"),
    ("second", 5, 5, "RB"),
    ("later", 1, 1, "AM"),
    ("later", 2, 1, "AM"),
    ("later", 2, 2, "AM"),
    ("later", 3, 1, "CM"),
    ("later", 3, 2, "DM"),
    ("later", 3, 3, "CM"),
    ("later", 4, 1, "LW"),
    ("later", 4, 2, "CM"),
    ("later", 4, 3, "CM"),
    ("later", 4, 4, "RW"),
    ("later", 5, 1, "LB"),
    ("later", 5, 2, "CM"),
    ("later", 5, 3, "DM"),
    ("later", 5, 4, "CM"),
    ("later", 5, 5, "RB"),
)


def template_rows() -> list[tuple[str, int, int, int, str]]:
    return list(TEMPLATES)


def generic_rows() -> list[tuple[str, int, int, str]]:
    return list(GENERIC)
