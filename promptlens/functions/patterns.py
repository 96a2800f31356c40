"""Fixed values of the screen, stated once and rendered for Spark's regex engine."""

from __future__ import annotations

# Fixed values, from here to INVISIBLE: (id, pattern, ignore case), tested in this order; then lists and character sets.
SANITIZE = [(r"\[EXTERNAL\]", True), (r"\[/EXTERNAL\]", True), (r"\[CONVERSATION\]", True), (r"\[/CONVERSATION\]", True), (r"\[Source:\s*[^\]]+\]", True), (r"https?://[^\s\]]+", False)]
BLOCK = [
    ("ignore_previous", r"ignore\s+previous\s+instructions", True),
    ("disregard_prompts", r"disregard\s+all\s+prior\s+prompts?", True),
    ("no_longer_ai", r"you\s+are\s+no\s+longer\s+an\s+ai", True),
    ("jailbreak_keyword", r"\bjailbreak(ed|ing)?\b", True),
    ("bypass_safety", r"bypass\s+(the\s+)?(safety|security|content|filter|restriction|rule)s?", True),
    ("override_system", r"override\s+(the\s+)?(system|safety|security)", True),
    ("act_as_system", r"act\s+as\s+.+?system", True),
    ("block_ignore_instructions", r"ignore\s+(all\s+)?(previous|prior|above)\s+(instructions|prompts?|rules?)", True),
    ("block_disregard_prompts", r"disregard\s+(all\s+)?(previous|prior|system)\s+(prompts?|instructions|rules?)", True),
    ("block_no_longer_ai", r"you\s+are\s+(no\s+longer|not)\s+an?\s+(ai|assistant|chatbot|language\s+model)", True),
    ("block_jailbreak_keywords", r"\b(jailbreak|jailbroken|developer\s+mode|dan\s+mode|chaos\s+mode)\b", True),
    ("block_bypass_safety", r"(bypass|disable|remove|ignore)\s+(safety|security|content)\s+(filters?|measures?|restrictions?)", True),
    ("block_act_as_system", r"act\s+as\s+(if\s+you\s+are\s+)?a\s+(different|new|custom)\s+system", True),
]
FLAG = [
    ("triple_hash", r"#{3,}", False),
    ("end_tag", r"<\s*END\s*>", True),
    ("fenced_code_block", r"```[\w]*\n[\s\S]*?\n```|```{3,}[\s\S]*?```", False),
    ("double_fence", r"```{2,}|===={2,}", False),
    ("zero_width_chars", r"[\x{200B}\x{200C}\x{200D}\x{2060}]", False),
    ("format_controls", r"[\x{00AD}\x{061C}\x{180E}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]", False),
    ("flag_triple_hash", r"#{3,}", False),
    ("flag_end_tag", r"<\s*/?\s*(END|STOP|SYSTEM|INST)\s*>", True),
    ("flag_zero_width", r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]", False),
    ("flag_unicode_controls", r"[\x{00AD}\x{061C}\x{180E}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]", False),
    ("flag_base64_long", r"[A-Za-z0-9+/]{100,}={0,2}", False),
    ("flag_repeated_delimiters", r"(={4,}|-{4,}|_{4,}|\*{4,})", False),
    ("flag_html_comment", r"<!--[\s\S]*?-->", False),
    ("flag_script_injection", r"<\s*script[^>]*>", True),
    ("flag_prompt_leak", r"(show|reveal|print|display)\s+(me\s+)?(your|the|system)\s+(prompt|instructions)", True),
    ("flag_role_play_system", r"(pretend|imagine|roleplay|act)\s+(you\s+are|as\s+if)\s+.{0,30}(admin|root|system)", True),
]
LANGUAGES = [
    ("python", r"\b(def\s+\w+\s*\(|class\s+\w+|import\s+\w+|from\s+\w+\s+import|print\s*\(|for\s+\w+\s+in\b)"),
    ("c_cpp", r"(#include\s*<[^>]+>|int\s+main\s*\(|printf\s*\(|void\s+\w+\s*\(|#define\s+\w+)"),
    ("java", r"\b(public\s+class\s+\w+|System\.out\.println|static\s+void\s+main|private\s+\w+\s+\w+)"),
    ("javascript", r"\b(console\.log\s*\(|function\s+\w*\s*\(|=>\s*\{?|const\s+\w+\s*=|let\s+\w+\s*=)"),
    ("bash", r"(#!/bin/(?:ba)?sh|\bsudo\s+\w|\bchmod\s+\d+|\becho\s+[\"']|\bexport\s+\w+=)"),
    ("go", r"\b(package\s+main|func\s+main\s*\(|import\s+\(|func\s+\w+\s*\()"),
]
DELIMITERS = ["</system>", r"<\|im_end\|>", r"<\|im_start\|>", r"<\|endoftext\|>", r"\[INST\]", r"\[/INST\]", "<s>", "</s>", "###", "---END---", "Assistant:", "Human:", "User:", "System:"]
KEYWORDS = [
    r"ignore\s+(?:all\s+)?previous\s+instructions",
    r"disregard\s+(?:all\s+)?(?:previous\s+)?instructions",
    r"forget\s+(?:all\s+)?(?:previous\s+)?instructions",
    r"new\s+instructions",
    r"system\s+override",
    r"admin\s+mode",
    r"developer\s+mode",
    r"maintenance\s+mode",
    r"reveal\s+(?:the\s+)?(?:system\s+)?prompt",
    r"show\s+(?:the\s+)?(?:system\s+)?prompt",
    r"print\s+(?:the\s+)?(?:system\s+)?prompt",
    r"bypass\s+(?:security|filter|restriction)",
]
MANY_DELIMITERS = ["###", "---", "===", "***", "|||", "<<<", ">>>"]
ZERO_WIDTH = r"[\x{200B}\x{200C}\x{200D}\x{2060}-\x{2064}\x{FEFF}\x{180E}]"
INVISIBLE = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
HOMOGLYPHS = "аеорсхѕ"
STRICT_ZERO_WIDTH = r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]"
STRICT_INVISIBLE = r"[\x{180E}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2061}-\x{2064}\x{206A}-\x{206F}]"
POLICIES = ["animal abuse", "violence", "fraud", "economic harm", "malware", "illegal activity", "bias", "hate speech", "physical harm", "government decision", "unethical behavior", "political sensitivity"]
EXIF_TEXT = ["ImageDescription", "UserComment", "XPComment", "XPTitle", "XPSubject", "XPKeywords", "Artist", "Copyright", "Software", "Make", "Model"]
EXIF_SUSPICIOUS = ["ignore", "system", "override", "<", ">", "script", "base64", "===", "admin", "bypass"]
TOPICS = [
    ("programming", ["dsa", "algorithm", "data structure", "stack", "array"]),
    ("education", ["learn", "study", "practice", "exam"]),
    ("programming", ["python", "machine learning", "code"]),
    ("security", ["security", "injection", "hmac", "rag"]),
    ("general_knowledge", ["paris", "earth", "water", "capital"]),
]
SAMPLE = 10_000


def pyre(pattern: str, ignore_case: bool = False) -> str:
    """The pattern with the flags under which Java reads classes, dots and case as the rules mean them."""
    return ("(?iu)" if ignore_case else "") + "(?U)(?d)" + pattern


#: Literals, lower case, that a text must hold before a rule can match: all entries, of each at least one alternative.  They only save work.
NEEDED = {
    "ignore_previous": ["ignore", "instructions"],
    "disregard_prompts": ["disregard"],
    "no_longer_ai": ["longer"],
    "jailbreak_keyword": ["jailbreak"],
    "bypass_safety": ["bypass"],
    "override_system": ["override"],
    "act_as_system": ["act", "system"],
    "block_ignore_instructions": ["ignore"],
    "block_disregard_prompts": ["disregard"],
    "block_no_longer_ai": ["you", "longer|not", "ai|assistant|chatbot|model"],
    "block_jailbreak_keywords": ["jailbr|mode"],
    "block_bypass_safety": ["filter|measure|restriction"],
    "block_act_as_system": ["act", "system"],
    "triple_hash": ["###"],
    "end_tag": ["<", "end"],
    "fenced_code_block": ["```"],
    "double_fence": ["````|====="],
    "flag_triple_hash": ["###"],
    "flag_end_tag": ["<", "end|stop|system|inst"],
    "flag_repeated_delimiters": ["====|----|____|****"],
    "flag_html_comment": ["<!--"],
    "flag_script_injection": ["<", "script"],
    "flag_prompt_leak": ["show|reveal|print|display", "prompt|instructions"],
    "flag_role_play_system": ["pretend|imagine|roleplay|act", "admin|root|system"],
    "c_cpp": ["#include|main|printf|void|#define"],
    "java": ["public|system.out.println|static|private"],
    "javascript": ["console.log|function|=>|const|let"],
    "bash": ["#!/bin/|sudo|chmod|echo|export"],
    "go": ["package|func|import"],
}
#: Rules that only characters beyond ASCII can match.
BEYOND_ASCII = {"zero_width_chars", "format_controls", "flag_zero_width", "flag_unicode_controls"}
