"""Manifests, sampled technologies and the signs of user interfaces and background jobs."""

from .technology_text import TECHNOLOGIES


def technology_rules():
    """Rows (language, category, technology, pattern)."""
    rows = []
    for language in ["python", "java", "javascript", "typescript", "csharp"]:
        text = TECHNOLOGIES["javascript" if language == "typescript" else language]
        for line in text.strip().splitlines():
            category, technology, pattern = line.split(" : ", 2)
            rows.append((language, category, technology, pattern))
    return rows


# Manifest names read at the top of a project.
ROOT_MANIFESTS = (
    "package.json requirements.txt pom.xml build.gradle Gemfile composer.json project.json *.csproj"
).split()

# (category, label, words): a label shows when one of a project's first files contains a word.
SAMPLED_TECHNOLOGIES = [
    ("frameworks", "Spring Boot", ["spring", "@controller"]),
    ("frameworks", "Flask", ["flask", "from flask"]),
    ("frameworks", "Express.js", ["express", "app.get"]),
    ("logging", "Standard Logging", ["logging", "logger"]),
    ("logging", "SLF4J/Logback", ["logback", "slf4j"]),
    ("logging", "Winston", ["winston"]),
    ("testing", "JUnit", ["junit", "@test"]),
    ("testing", "Python Testing", ["pytest", "unittest"]),
    ("testing", "JavaScript Testing", ["jest", "mocha"]),
]
SAMPLED_FILES = 10

UI_SUFFIXES = ".html .htm .css .scss .sass .less .jsx .tsx .vue .svelte".split()
UI_DIRS = (
    "src/components components views pages static/css static/js public assets/css www"
).split()
UI_PACKAGES = (
    "react vue angular @angular svelte jquery bootstrap material-ui antd react-dom"
).split()
# Each of these in a file's text marks a user interface.
UI_PATTERNS = [
    r"import\s+React", r"""from\s+["\']react["\']""", r"React\.Component", r"\.jsx$", r"jsx",
    r"import.*Vue", r"Vue\.component", r"@Component", r"\.vue$",
    r"@angular/core", r"@Component", r"@Injectable.*Component", r"\.component\.ts$",
    r"\.svelte$", r"import.*svelte",
    r"\.css$", r"\.scss$", r"\.sass$", r"\.less$",
    r"react-native", r"@react-native", r"StyleSheet\.create", r"View,", r"Text,",
    r"import.*flutter", r"\.dart$", r"Widget.*build", r"StatelessWidget", r"StatefulWidget",
    r"Xamarin\.Forms", r"ContentPage", r"StackLayout",
    r"electron", r"BrowserWindow", r"ipcRenderer",
    r"import tkinter", r"from tkinter", r"Tk\(\)", r"mainloop\(\)",
    r"PyQt", r"QApplication", r"QWidget", r"QMainWindow",
    r"System\.Windows\.Controls", r"UserControl", r"Window\.xaml",
    r"System\.Windows\.Forms", r"Form.*Designer", r"Button.*Click",
]
# These count only in a file with at least two of the tags.
HTML_PATTERNS = [r"\.html$", r"\.htm$"]
HTML_TAGS = ["<html", "<head>", "<body>", "<div", "<span", "<p>", "<h1", "<h2", "<h3"]
HTML_TAGS_NEEDED = 2
# These count only in a file with a browser word and without a server word.
SCRIPT_PATTERNS = [
    r"document\.getElementById", r"document\.querySelector", r"addEventListener", r"window\.",
]
BROWSER_WORDS = ["getelementbyid", "queryselector", "addeventlistener", "window.location"]
SERVER_WORDS = ["express", "app.get", "app.post", "require(", "module.exports"]

BACKGROUND_PATTERNS = [
    r"import celery", r"@task", r"@shared_task",
    r"import rq", r"@job", r"Queue\(",
    r"crontab", r"@cron", r"schedule\.",
    r"import threading", r"Thread\(", r"ThreadPoolExecutor",
    r"import asyncio", r"async def", r"await ", r"asyncio\.create_task",
    r"import multiprocessing", r"Process\(", r"Pool\(",
    r"background.*task", r"BackgroundTasks", r"@background",
    r"worker\.py", r"workers/", r"job.*queue",
]
