"""Errors of programs and records."""


class ConfigError(ValueError):
    """A program that can't be used; the message names the line where it is known."""

    def __init__(self, message: str, line: int | None = None, column: int | None = None) -> None:
        where = f"yaml line {line}{'' if column is None else f':{column}'}: " if line is not None else ""
        super().__init__(where + message)
        self.line, self.column = line, column
