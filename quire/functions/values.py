"""Names, tables, constants, patterns and formats that results depend on."""

# --- formats -----------------------------------------------------------------
FORMATS = ["epub", "pdf", "txt", "mobi", "azw3", "docx", "html", "md"]

FORMAT_NAMES = {
    "epub": "EPUB",
    "pdf": "PDF",
    "txt": "纯文本",
    "mobi": "MOBI",
    "azw3": "AZW3",
    "docx": "Word文档",
    "html": "HTML",
    "md": "Markdown",
}

MIME_TYPES = {
    "epub": "application/epub+zip",
    "pdf": "application/pdf",
    "txt": "text/plain",
    "mobi": "application/x-mobipocket-ebook",
    "azw3": "application/vnd.amazon.ebook",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "html": "text/html",
    "md": "text/markdown",
}

ALLOWED_EXTENSIONS = [".epub", ".pdf", ".txt", ".mobi", ".azw3"]
MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_BATCH_FILES = 50

# --- conversion --------------------------------------------------------------
ROUTES = {
    ("epub", "pdf"): "epub_to_pdf",
    ("pdf", "epub"): "pdf_to_epub",
    ("txt", "pdf"): "txt_to_pdf",
    ("txt", "epub"): "txt_to_epub",
    ("epub", "txt"): "epub_to_txt",
    ("pdf", "txt"): "pdf_to_txt",
    ("mobi", "txt"): "mobi_to_txt",
    ("mobi", "pdf"): "mobi_to_pdf",
    ("azw3", "txt"): "azw3_to_txt",
    ("azw3", "pdf"): "azw3_to_pdf",
}

CONVERTIBLE = {
    "epub": ["pdf", "txt", "html", "mobi"],
    "pdf": ["txt", "html", "epub"],
    "txt": ["pdf", "epub", "html", "mobi"],
    "mobi": ["epub", "pdf", "txt", "html"],
    "azw3": ["epub", "pdf", "txt", "html"],
    "docx": ["pdf", "txt", "html", "epub"],
    "html": ["pdf", "epub", "txt", "mobi"],
    "md": ["pdf", "html", "epub", "txt"],
}

QUALITY_SECONDS = {"draft": 1.0, "standard": 3.0, "high": 8.0, "premium": 15.0}

STAGE_WEIGHTS = {
    "pdf_analysis": 0.1,
    "content_extraction": 0.3,
    "structure_recognition": 0.2,
    "ai_enhancement": 0.2,
    "epub_generation": 0.2,
}

QUALITY_THRESHOLD = 60.0
OCR_CONFIDENCE_THRESHOLD = 85.0
IMAGE_WIDTHS = {"fast": 600, "standard": 800, "high": 1200}

# --- chapter rules -----------------------------------------------------------
CHAPTER_WORD_PATTERN = r"^(Chapter|章|第\s*\d+章|Part|部分|Section|节)\s*\d+"
BOOKMARK_WORD_PATTERN = r"^(Chapter|第|章|Part|部分|Section|节)\s*\d+"
LIST_HEAD_PATTERNS = [r"^\d+\.\s+", r"^[IVXLCDM]+\.\s+", r"^[A-Z]\.\s+"]
SENTENCE_ENDS = [".", "!", "?", "。", "！", "？"]
SENTENCE_WORDS = ["the", "and", "or", "but", "because"]
PAGE_PREFIX_PATTERN = r"^Page\s*\d+\s*[:\-]?\s*"
TITLE_BULLETS = "•·-—–"
GENERIC_TITLES = ["chapter", "section", "part"]

DETECTORS = ["bookmark", "font_analysis", "page_pattern", "ai_analysis"]
DETECTOR_WEIGHTS = {"bookmark": 1.0, "font_analysis": 0.8, "page_pattern": 0.6, "ai_analysis": 0.7}
OTHER_DETECTOR_WEIGHT = 0.5

# --- templates ---------------------------------------------------------------
CHAPTER_HTML_HEAD = (
    "<!DOCTYPE html>\n"
    '<html xmlns="http://www.w3.org/1999/xhtml">\n'
    "<head>\n"
    "    <title>{title}</title>\n"
    '    <meta charset="utf-8"/>\n'
    '    <link rel="stylesheet" type="text/css" href="../style/nav.css"/>\n'
    "</head>\n"
    "<body>\n"
    '    <div class="chapter">\n'
    '        <h1 class="chapter-title">{title}</h1>\n'
    '        <div class="chapter-content">\n'
)
CHAPTER_HTML_TAIL = "\n        </div>\n    </div>\n</body>\n</html>\n"
PLAIN_HTML = (
    "<html><head><title>{title}</title></head>"
    "<body><h1>{title}</h1><p>{body}</p></body></html>"
)
HTML_ESCAPES = [("&", "&amp;"), ('"', "&quot;"), ("'", "&#39;"), (">", "&gt;"), ("<", "&lt;")]

BINARY_TEXT_PATTERN = r"""[a-zA-Z0-9\s\.,!?;:"'-]+"""
BINARY_TEXT_NOTE = (
    "{kind} file: {name}\n\nThis is a converted {kind} file. Basic text extraction applied."
    "\n\nOriginal file size: {size} bytes"
)

# --- prompts -----------------------------------------------------------------
SUMMARY_PROMPT = "请为以下文本生成一个简洁的摘要，长度约为{max_length}字符：\n\n{text}"
SUMMARY_INPUT_CHARS = 2000
ENHANCE_INPUT_CHARS = 3000
ENHANCE_MAX_TOKENS = 1000
ENHANCE_PROMPTS = {
    "improve_readability": "请改善以下文本的可读性，使其更易于理解，保持原意：",
    "fix_grammar": "请修正以下文本中的语法错误和拼写错误：",
    "translate_to_chinese": "请将以下文本翻译成中文：",
    "translate_to_english": "请将以下文本翻译成英文：",
    "format_content": "请对以下文本进行格式化，添加适当的段落分隔和标点符号：",
}
REQUEST_OPTIONS = {
    "summary": (300, 0.3),
    "writing_improvement": (1000, 0.5),
    "translation": (1500, 0.2),
    "chapter_generation": (500, 0.7),
    "formatting": (800, 0.3),
}

# --- errors ------------------------------------------------------------------
# exception class -> (code, HTTP status)
APPLICATION_ERRORS = {
    "ValidationError": ("VALIDATION_ERROR", 422),
    "ResourceNotFoundError": ("RESOURCE_NOT_FOUND", 404),
    "SecurityError": ("SECURITY_ERROR", 403),
    "FileProcessingError": ("FILE_PROCESSING_ERROR", 400),
    "ConversionTimeoutError": ("CONVERSION_TIMEOUT", 503),
    "BatchConversionError": ("BATCH_CONVERSION_ERROR", 500),
    "ConversionError": ("CONVERSION_ERROR", 500),
    "AIServiceError": ("AI_SERVICE_ERROR", 500),
    "ConfigurationError": ("CONFIGURATION_ERROR", 500),
}
BUILTIN_ERRORS = {
    "FileNotFoundError": ("RESOURCE_NOT_FOUND", 404),
    "PermissionError": ("SECURITY_ERROR", 403),
    "ValueError": ("VALIDATION_ERROR", 422),
    "TimeoutError": ("CONVERSION_TIMEOUT", 503),
}
ERROR_TEMPLATES = {
    "FILE_NOT_FOUND": (
        "文件未找到",
        "您指定的文件不存在，请检查文件路径是否正确。",
        ["确认文件路径拼写正确", "检查文件是否已被移动或删除", "尝试重新上传文件"],
    ),
    "FILE_PROCESSING_ERROR": (
        "文件处理失败",
        "处理您的文件时出现问题，可能是文件格式不受支持或文件已损坏。",
        ["确认文件格式是否受支持（EPUB、PDF、TXT）", "检查文件是否完整且未损坏", "尝试使用其他文件"],
    ),
    "VALIDATION_ERROR": (
        "输入验证失败",
        "您提供的信息格式不正确，请检查输入内容。",
        ["检查必填字段是否完整", "确认数据格式符合要求", "参考API文档中的示例"],
    ),
    "CONVERSION_ERROR": (
        "格式转换失败",
        "无法将文件转换为目标格式，请检查文件内容和格式要求。",
        ["确认源文件格式正确", "检查目标格式是否受支持", "如果是大文件，请稍后重试"],
    ),
    "CONVERSION_TIMEOUT": (
        "转换超时",
        "文件转换时间过长，可能是文件太大或服务器繁忙。",
        ["尝试转换较小的文件", "稍后重试", "联系技术支持获取帮助"],
    ),
    "AI_SERVICE_ERROR": (
        "AI服务暂时不可用",
        "AI处理服务遇到问题，请稍后再试。",
        ["等待几分钟后重试", "检查网络连接", "如问题持续存在，请联系支持团队"],
    ),
    "CONFIGURATION_ERROR": (
        "系统配置错误",
        "服务配置有误，请联系管理员。",
        ["联系系统管理员", "稍后重试", "查看系统状态页面"],
    ),
    "SECURITY_ERROR": (
        "访问被拒绝",
        "您没有权限执行此操作。",
        ["检查您的访问权限", "联系管理员获取权限", "确认您已正确登录"],
    ),
    "INTERNAL_ERROR": (
        "系统内部错误",
        "系统遇到了意外错误，我们正在调查此问题。",
        ["稍后重试", "如问题持续存在，请联系技术支持", "记录错误ID以便技术支持定位问题"],
    ),
    "HTTP_ERROR": (
        "请求错误",
        "您的请求格式不正确或包含无效数据。",
        ["检查请求参数", "参考API文档", "确认请求方法正确"],
    ),
}
TIMEOUT_MESSAGE = "文件转换超时（{seconds}秒），请尝试较小的文件或稍后重试。"
PROVIDER_MESSAGE = "{provider} AI服务暂时不可用，请稍后再试。"
