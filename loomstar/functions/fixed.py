"""Seeds of dimensions and lookup tables that results depend on."""

TOOL_CATEGORIES = {
    "Read": "file_operations",
    "Write": "file_operations",
    "Edit": "file_operations",
    "MultiEdit": "file_operations",
    "NotebookEdit": "file_operations",
    "Glob": "file_operations",
    "Grep": "search",
    "WebSearch": "search",
    "Bash": "execution",
    "BashOutput": "execution",
    "KillShell": "execution",
    "WebFetch": "web",
    "Task": "task_management",
    "TodoWrite": "task_management",
    "EnterPlanMode": "planning",
    "ExitPlanMode": "planning",
    "Skill": "other",
    "SlashCommand": "other",
    "AskUserQuestion": "interaction",
}
MODEL_FAMILIES = ["opus", "sonnet", "haiku"]
ENTITY_TYPES = ["file_path", "url", "function_name", "class_name", "variable_name", "package_name", "error_code", "git_ref"]
INTENTS = [
    ("bug_fix", "problem_solving", "Fix a bug or error"),
    ("feature", "development", "Add new functionality"),
    ("refactor", "development", "Improve code structure"),
    ("question", "inquiry", "Ask about code or concepts"),
    ("explain", "inquiry", "Request explanation"),
    ("review", "analysis", "Review or analyze code"),
    ("test", "quality", "Write or run tests"),
    ("debug", "problem_solving", "Debug an issue"),
    ("config", "setup", "Configuration or setup"),
    ("docs", "documentation", "Documentation work"),
]
SENTIMENTS = [("neutral", 0.0), ("positive", 0.5), ("negative", -0.5), ("frustrated", -0.8), ("satisfied", 0.8), ("confused", -0.3), ("curious", 0.3)]
TOPICS = [
    ("frontend", "domain"),
    ("backend", "domain"),
    ("database", "domain"),
    ("api", "domain"),
    ("auth", "domain"),
    ("testing", "practice"),
    ("deployment", "practice"),
    ("security", "concern"),
    ("performance", "concern"),
    ("architecture", "design"),
]
MESSAGE_TYPES = ["user", "assistant"]
BLOCK_TYPES = ["text", "tool_use", "tool_result", "thinking", "image"]
LANGUAGE_EXTENSIONS = {
    "python": [".py", ".pyw", ".pyi"],
    "javascript": [".js", ".jsx", ".mjs"],
    "typescript": [".ts", ".tsx"],
    "java": [".java"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp", ".hh"],
    "csharp": [".cs"],
    "go": [".go"],
    "rust": [".rs"],
    "ruby": [".rb"],
    "php": [".php"],
    "swift": [".swift"],
    "kotlin": [".kt", ".kts"],
    "scala": [".scala"],
    "r": [".r", ".R"],
    "sql": [".sql"],
    "html": [".html", ".htm"],
    "css": [".css", ".scss", ".sass", ".less"],
    "json": [".json"],
    "yaml": [".yaml", ".yml"],
    "xml": [".xml"],
    "markdown": [".md", ".markdown"],
    "shell": [".sh", ".bash", ".zsh"],
    "powershell": [".ps1", ".psm1"],
    "dockerfile": ["Dockerfile"],
    "toml": [".toml"],
}
HINT_ALIASES = {
    "py": "python",
    "js": "javascript",
    "ts": "typescript",
    "rb": "ruby",
    "sh": "shell",
    "bash": "shell",
    "zsh": "shell",
    "yml": "yaml",
    "md": "markdown",
    "c++": "cpp",
    "c#": "csharp",
    "jsx": "javascript",
    "tsx": "typescript",
}
CODE_FENCE = r"```(\w*)\n(.*?)```"
ENTITY_PATTERNS = {
    "file_path": r"""(?:^|[\s"'])(/[a-zA-Z0-9_\-./]+\.[a-zA-Z0-9]+|[a-zA-Z]:\\[a-zA-Z0-9_\-\\./]+\.[a-zA-Z0-9]+|\./[a-zA-Z0-9_\-./]+\.[a-zA-Z0-9]+)""",
    "url": r"https?://[a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+",
    "function_name": r"\bdef\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(|\bfunction\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(|\bconst\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*(?:async\s*)?\(|\bfunc\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(",
    "class_name": r"\bclass\s+([A-Z][a-zA-Z0-9_]*)|\binterface\s+([A-Z][a-zA-Z0-9_]*)|\bstruct\s+([A-Z][a-zA-Z0-9_]*)",
    "package_name": r"""\bimport\s+([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)*)|\bfrom\s+([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)*)\s+import|\brequire\s*\(\s*["']([a-zA-Z0-9@/_\-]+)["']\s*\)""",
    "error_code": r"\b(E[0-9]{4}|ERR_[A-Z_]+|[A-Z]+Error|[A-Z]+Exception)\b",
    "git_ref": r"\b([a-f0-9]{7,40})\b|\b(HEAD~?\d*|main|master|develop|feature/[a-zA-Z0-9_\-]+|release/[a-zA-Z0-9._\-]+|hotfix/[a-zA-Z0-9_\-]+)\b",
}
GIT_WORD = r"git|branch|checkout|merge|rebase"
COMMIT = r"\[[\w\-/]+ ([a-f0-9]{7,})\] (.+?)(?:\n|$)"
REPOSITORY = r"github\.com/([a-zA-Z0-9_-]+/[a-zA-Z0-9_-]+)/pull/new/"
TOOL_SHORT_NAMES = {"Bash": "bash", "Read": "read", "Write": "write", "Edit": "edit", "Glob": "glob", "Grep": "grep", "Task": "task", "TodoWrite": "todo", "WebFetch": "fetch", "WebSearch": "search"}
PROJECT_PREFIXES = ["-home-", "-mnt-c-users-", "-users-"]
PROJECT_COMMON = ["projects", "code", "repos", "src", "dev", "work", "documents"]
TRUNCATE, LONG_TEXT, PROMPTS_PER_PAGE, SNIPPET = 2000, 300, 5, 200
