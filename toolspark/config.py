"""Settings of the parsers and the fixed tables they use."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

#: fixed values: tool names and what the call parser makes of them
TOOL_ALIASES = {
    "readfile": "read_file", "writefile": "write_file", "strreplace": "str_replace", "tool_search": "search", "tool_bash": "bash", "tool_read_file": "read_file", "tool_write_file": "write_file",
    "tool_str_replace": "str_replace", "grep": "search", "grep_search": "search", "view": "read_file", "view_file": "read_file", "edit": "str_replace", "edit_file": "str_replace", "sh": "bash", "shell": "bash", "terminal": "bash",
}
#: fixed values: parameter names and what the call parser makes of them
PARAM_ALIASES = {"cmd": "command", "file": "path", "filepath": "path", "file_path": "path", "target_file": "path", "filename": "path", "query": "pattern", "old": "old_str", "new": "new_str"}
#: fixed values: parameters whose text is code and keeps its white space
CODE_PARAMS = frozenset(["old_str", "new_str", "content", "old", "new", "code", "text", "replacement", "patch", "diff"])
#: fixed values: parameters that become integers if they are digits
INT_PARAMS = ("offset", "limit", "line_number", "line", "timeout")
#: fixed values: keys that hold a call's arguments, and keys that wrap them once more
ARGS_KEYS = ("arguments", "parameters", "params", "args", "action_input", "tool_input")
WRAPPER_KEYS = (*ARGS_KEYS, "input")
#: fixed values: keys that hold a call's name
NAME_KEYS = ("name", "tool", "tool_name", "action", "function")
#: fixed values: positional arguments by tool
POSITIONAL = {"bash": ["command"], "sh": ["command"], "shell": ["command"], "terminal": ["command"], "search": ["pattern"], "grep": ["pattern"], "read_file": ["path"], "view": ["path"], "write_file": ["path", "content"]}
#: fixed values: tags around a call
CALL_TAGS = ["tool_invoke", "invoke", "tool_call", "call", "tool", "invocation", "function_call", "function", "func", "action", "tool_use", "ant_tool_use", "function_use", "действие", "вызов_функции", "функция", "инструмент"]
PARAM_TAGS = ["parameter", "param", "arg", "argument", "параметр", "аргумент"]
GROUP_TAGS = ["tool_call", "tool_calls", "function_calls", "calls", "tools"]
#: fixed values: what may follow an unfinished thought
TOOL_MARKS = ["<tool_call", "<tool_calls", "<tools", "<tool", "<invoke", "<dsml", "<call", "<tool_use", "<ant_tool_use", "<action_start", "<action_name", "<python_tag", "```", "action:", "✿function✿"]
#: fixed values: Python functions that are no tools unless listed
BUILTINS = frozenset("print len range str int float list dict set tuple isinstance type enumerate zip sum min max open help id input eval exec".split())
#: fixed values: prose before a call on its line
CALL_PREFIXES = ["вызов:", "вызываю", "инструмент:", "действие:", "команда:", "调用:", "调用", "工具:", "执行:", "호출:", "도구:", "call:", "calling", "action:", "tool:", "run:", "execute:", "invoke:"]

#: fixed values: canonical names and categories
CATEGORIES = {
    "edit": {"edit": "edit", "write": "write", "str_replace": "str_replace", "write_file": "write_file", "edit_file": "edit_file", "save_file": "save_file", "replace": "replace", "notebookedit": "notebookedit", "apply_diff": "apply_diff", "create_file": "write_file", "modify_file": "edit_file", "patch_file": "apply_diff"},
    "exec": {"bash": "bash", "execute_bash": "bash", "run_bash": "bash", "terminal": "bash", "cmd": "bash", "execute_command": "bash", "run_shell": "bash"},
    "read": {"read": "read", "read_file": "read", "view": "read", "view_file": "read", "cat": "read", "head": "read", "tail": "read"},
    "search": {"grep": "grep", "grep_search": "grep", "search": "search", "file_search": "file_search", "find": "find", "glob": "glob", "list_dir": "list_dir", "list_directory": "list_dir", "ls": "list_dir"},
    "test": {"pytest": "pytest", "run_tests": "run_tests", "test": "test", "l0_run_test": "l0_run_test"},
    "submit": {"submit": "submit", "finish": "finish", "complete": "complete", "exit": "exit"},
    "l0_accel": {n: n for n in ("l0_verify_syntax", "l0_verify_edit_scope", "l0_clean_test_log", "l0_view_outline", "l0_format_diff")},
}
#: fixed values: argument names across agents
ARG_ALIASES = {"file_path": "path", "filepath": "path", "filename": "path", "target_file": "path", "file": "path", "old_string": "old_str", "old_text": "old_str", "old_code": "old_str", "new_string": "new_str", "new_text": "new_str", "new_code": "new_str", "cmd": "command", "shell_command": "command", "query_string": "query"}
#: fixed values: commands that test, and marks of commands that change files
TEST_COMMANDS = ["pytest", "python -m unittest", "python -m pytest", "./tests/runtests.py", "python tests/runtests.py", "runtests.py", "tox", "nosetests", "ctest", "cargo test", "go test", "npm test"]
CHANGE_MARKS = [">", ">>", "tee ", "patch", "sed -i", "git apply", "git checkout"]
#: fixed values: parts of unknown names that tell a category, in order
NAME_HINTS = {"edit": ["edit", "write", "patch", "replace"], "test": ["test", "check", "verify"], "exec": ["bash", "exec", "shell", "run"], "read": ["read", "view", "show", "cat"], "search": ["search", "find", "grep", "list"], "submit": ["submit", "finish", "complete"]}
VERIFY_TOOLS = ["l0_verify_syntax", "l0_verify_edit_scope", "l0_run_test"]


@dataclass(frozen=True)
class ParserConfig:
    """What a parser accepts and renames. ``keep_input`` keeps plain-text input that has no named parameter."""

    allowed_tools: tuple[str, ...] | None = None
    tool_aliases: dict[str, str] = field(default_factory=dict)
    param_aliases: dict[str, str] = field(default_factory=dict)
    code_param_keys: frozenset[str] = CODE_PARAMS
    strip_thinking: bool = True
    allow_shell_fallback: bool = False
    keep_input: bool = False

    def names(self) -> dict[str, str]:
        return self._names

    def params(self) -> dict[str, str]:
        return self._params

    @cached_property
    def _names(self) -> dict[str, str]:
        return TOOL_ALIASES | {k.lower(): v.lower() for k, v in self.tool_aliases.items()}

    @cached_property
    def _params(self) -> dict[str, str]:
        return PARAM_ALIASES | {k.lower(): v for k, v in self.param_aliases.items()}

    def allows(self, name: str) -> bool:
        return bool(name.strip()) and (self.allowed_tools is None or name in self.allowed_tools)
