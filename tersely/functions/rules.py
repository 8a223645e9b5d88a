"""Ordered rewrite rules by category: (pattern, replacement), ``$1`` for a group."""

from __future__ import annotations

# Rules of the specification, in their order.
FILLER_PHRASES = [
    (r"\bplease\s+note\s+that\b", ""),
    (r"\bit\s+is\s+important\s+to\s+note\s+that\b", ""),
    (r"\bit\s+should\s+be\s+noted\s+that\b", ""),
    (r"\bplease\s+make\s+sure\s+to\b", ""),
    (r"\bplease\s+ensure\s+that\b", "ensure"),
    (r"\bplease\s+remember\s+to\b", ""),
    (r"\bkindly\b", ""),
    (r"\bplease\b(?!\s+\w+\s+the)", ""),
    (r"\bin\s+order\s+to\b", "to"),
    (r"\bfor\s+the\s+purpose\s+of\b", "for"),
    (r"\bwith\s+the\s+goal\s+of\b", "to"),
    (r"\bdue\s+to\s+the\s+fact\s+that\b", "because"),
    (r"\bin\s+the\s+event\s+that\b", "if"),
    (r"\bat\s+this\s+point\s+in\s+time\b", "now"),
    (r"\bat\s+the\s+present\s+time\b", "now"),
    (r"\bin\s+a\s+manner\s+that\b", "so that"),
    (r"\bas\s+a\s+result\s+of\b", "from"),
    (r"\bprior\s+to\b", "before"),
    (r"\bsubsequent\s+to\b", "after"),
    (r"\bin\s+the\s+case\s+that\b", "if"),
    (r"\bfor\s+the\s+reason\s+that\b", "because"),
    (r"\bwith\s+regard\s+to\b", "re:"),
    (r"\bwith\s+respect\s+to\b", "re:"),
    (r"\bin\s+regard\s+to\b", "re:"),
    (r"\bin\s+terms\s+of\b", "for"),
    (r"\bactually\b", ""),
    (r"\bbasically\b", ""),
    (r"\bessentially\b", ""),
    (r"\bfundamentally\b", ""),
    (r"\bliterally\b", ""),
    (r"\bobviously\b", ""),
    (r"\bclearly\b", ""),
    (r"\bneedless\s+to\s+say\b", ""),
    (r"\bit\s+goes\s+without\s+saying\b", ""),
    (r"\bas\s+you\s+know\b", ""),
    (r"\bas\s+we\s+all\s+know\b", ""),
    (r"\butilize\b", "use"),
    (r"\butilization\b", "use"),
    (r"\bimplement\b", "add"),
    (r"\bimplementation\b", "adding"),
    (r"\bfacilitate\b", "help"),
    (r"\bfacilitation\b", "help"),
    (r"\bdemonstrate\b", "show"),
    (r"\bdemonstration\b", "demo"),
    (r"\bsubsequently\b", "then"),
    (r"\bnevertheless\b", "but"),
    (r"\bnonetheless\b", "but"),
    (r"\bwith\s+the\s+exception\s+of\b", "except"),
    (r"\bof\s+the\s+opinion\s+that\b", "think"),
    (r"\ba\s+sufficient\s+amount\s+of\b", "enough"),
    (r"\ban\s+insufficient\s+amount\s+of\b", "not enough"),
    (r"\bfor\s+example\b", "e.g."),
    (r"\bthat\s+is\s+to\s+say\b", "i.e."),
    (r"\bthe\s+code\s+provided\s+below\s*:\s*", "Code: "),
    (r"\bthe\s+following\s+code\s*:\s*", "Code: "),
    (r"\bthe\s+example\s+below\s*:\s*", "Example: "),
    (r"\bas\s+shown\s+below\s*:\s*", ""),
    (r"\bas\s+described\s+below\s*:\s*", ""),
    (r"\bthis\s+means\s+that\b", "meaning"),
    (r"\bwhat\s+this\s+means\s+is\b", "meaning"),
    (r"\bindicate\b", "show"),
]

# Rules of the specification, in their order.
IMPERATIVE_CONVERSIONS = [
    (r"\byou\s+should\b", ""),
    (r"\byou\s+must\b", ""),
    (r"\byou\s+need\s+to\b", ""),
    (r"\byou\s+are\s+required\s+to\b", ""),
    (r"\byou\s+are\s+expected\s+to\b", ""),
    (r"\bmake\s+sure\s+you\b", ""),
    (r"\bensure\s+that\s+you\b", ""),
    (r"\bremember\s+to\b", ""),
    (r"\bdon'?t\s+forget\s+to\b", ""),
    (r"\balways\s+make\s+sure\s+to\b", "always"),
    (r"\bbe\s+sure\s+to\b", ""),
    (r"\byou\s+will\s+(?:need\s+to|want\s+to|have\s+to)\b", ""),
    (r"\bit\s+is\s+(?:important|essential|critical|crucial|vital)\s+(?:that\s+you|to)\b", ""),
    (r"\bkeep\s+in\s+mind\s+that\b", ""),
    (r"\bbe\s+(?:mindful|aware|careful)\s+(?:of|that|to)\b", ""),
    (r"\bbe\s+(?:thorough|comprehensive|detailed)\b", ""),
    (r"\bpay\s+(?:attention|close\s+attention)\s+to\b", "note"),
    (r"\btake\s+care\s+to\b", ""),
    (r"\bstrive\s+to\b", ""),
    (r"\balways\s+follow\b", "follow"),
    (r"\balways\s+prioritize\b", "prioritize"),
    (r"\balways\s+verify\b", "verify"),
    (r"\balways\s+check\b", "check"),
    (r"\balways\s+include\b", "include"),
    (r"\balways\s+ensure\b", "ensure"),
    (r"\balways\s+provide\b", "provide"),
    (r"\balways\s+thank\b", "thank"),
    (r"\balways\s+consider\b", "consider"),
    (r"\balways\s+use\b", "use"),
    (r"\balways\s+maintain\b", "maintain"),
    (r"\balways\s+recommend\b", "recommend"),
    (r"\bnever\s+share\b", "don't share"),
    (r"\bnever\s+provide\b", "don't provide"),
    (r"\bnever\s+reveal\b", "don't reveal"),
    (r"\byou\s+are\s+a\b", "Act as"),
    (r"\byou\s+are\s+an\b", "Act as"),
    (r"\bin\s+addition\s*,?\s*\b", "Also "),
    (r"\bfurthermore\s*,?\s*\b", "Also "),
    (r"\bmoreover\s*,?\s*\b", "Also "),
    (r"\badditionally\s*,?\s*\b", "Also "),
]

# Rules of the specification, in their order.
CLAUSE_COLLAPSE = [
    (r"\bwhen\s+you\s+are\s+(?:doing|performing|completing|executing)\b", "when"),
    (r"\bwhile\s+you\s+are\s+(?:doing|performing|completing|executing)\b", "while"),
    (r"\bif\s+this\s+is\s+the\s+case\s*,?\s*then\b", "if so,"),
    (r"\bif\s+that\s+is\s+the\s+case\s*,?\s*then\b", "if so,"),
    (r"\bin\s+such\s+a\s+case\b", "then"),
    (r"\bin\s+this\s+case\b", "then"),
    (r"\bin\s+(?:the\s+)?case\s+(?:of|where|that)\b", "if"),
    (r"\bin\s+situations?\s+where\b", "when"),
    (r"\bin\s+(?:a|the)\s+scenario\s+where\b", "when"),
    (r"\bin\s+the\s+context\s+of\b", "for"),
    (r"\bwith\s+the\s+aim\s+of\b", "to"),
    (r"\bso\s+as\s+to\b", "to"),
    (r"\bfor\s+the\s+sake\s+of\b", "for"),
    (r"\bshould\s+be\s+(?:written|presented|structured)\s+in\s+(?:a\s+)?(?:clear|concise|simple)\b", "should be clear"),
    (r"\bshould\s+be\s+(?:easily|readily)\s+(?:understood|understandable|accessible)\b", "should be clear"),
    (r"\bcan\s+be\s+(?:easily|readily)\s+(?:understood|understandable|accessible)\b", "is clear"),
    (r"\bthat\s+(?:can|could|may|might)\s+be\s+used\s+to\b", "to"),
    (r"\bthat\s+are\s+(?:relevant|applicable|appropriate)\s+to\b", "for"),
    (r"\bthat\s+are\s+(?:related|pertaining)\s+to\b", "about"),
    (r"\bin\s+(?:a|the)\s+scenario\s+where\b", "when"),
    (r"\bin\s+situations?\s+where\b", "when"),
    (r"\bin\s+the\s+context\s+of\b", "for"),
    (r"\bwith\s+the\s+aim\s+of\b", "to"),
    (r"\bso\s+as\s+to\b", "to"),
    (r"\bfor\s+the\s+sake\s+of\b", "for"),
    (r"\b(\w+)\s+issues?,\s+(\w+)\s+(?:issues?|questions?),\s+and\s+(\w+)\s+(?:issues?|questions?|inquiries?)\b", "$1/$2/$3 issues"),
]

# Rules of the specification, in their order.
CREDENTIAL_STRIP = [
    (r"\bwith\s+(?:over\s+|more\s+than\s+)?\d+\+?\s+years?\s+(?:of\s+)?experience(?:\s+in\s+[\w\s]+?)?(?=\.)", ""),
    (r"\bwith\s+extensive\s+(?:knowledge|experience)\s+(?:of|in)\s+[\w\s]+(?=\.)", ""),
    (r"\bYou\s+are\s+(?:a|an)\s+(?:very\s+)?(?:helpful|experienced|knowledgeable|senior|skilled|expert)\s+(?:and\s+(?:friendly|supportive|experienced|knowledgeable)\s+)?", ""),
    (r"\bdesigned\s+to\s+(?:help|assist|support)\b", "helps"),
    (r"\bspecializing\s+in\s+([\w\s,]+?)(?=\.)", "($1 specialist)"),
    (r"\bwith\s+expertise\s+in\s+([\w\s]+?)(?=\.)", "($1 expert)"),
    (r"\bin\s+the\s+field\b", ""),
    (r"\bfor\s+a\s+\d[\d,]*-?\s*employee\s+(?:organization|company)\b", ""),
]

# Rules of the specification, in their order.
DISCLAIMER_COLLAPSE = [
    (r"(?:Please\s+note\s+that\s+)?(?:your|this)\s+(?:analysis|information|response)\s+should\s+not\s+be\s+considered\s+(?:as\s+)?(?:personalized\s+)?(?:legal|financial|medical|professional)\s+advice[^.]*\.", "[Not professional advice.]"),
    (r"(?:They|Users?|You)\s+should\s+(?:always\s+)?consult\s+with\s+(?:a\s+|their\s+)?(?:licensed\s+|qualified\s+)?(?:financial\s+advisor|legal\s+counsel|healthcare\s+professional|doctor|attorney)[^.]*\.", "[Consult a professional.]"),
    (r"(?:your\s+)?information\s+is\s+for\s+educational\s+purposes\s+only\s+and\s+should\s+not\s+be\s+used\s+as\s+a\s+substitute\s+for\s+professional[^.]*\.", "[Educational only.]"),
    (r"Always\s+(?:encourage|remind)\s+users?\s+to\s+consult\s+with\s+(?:qualified\s+)?(?:healthcare\s+)?professionals?[^.]*\.", ""),
    (r"(?:Always\s+)?(?:recommend|suggest)\s+that\s+[^.]*(?:be\s+reviewed|consult|seek\s+(?:legal|professional))[^.]*\.", ""),
    (r"(?:Please\s+)?remind\s+users?\s+(?:about\s+)?(?:the\s+importance\s+of|that\s+they\s+should)[^.]*\.", ""),
]

# Rules of the specification, in their order.
ADVERB_STRIP = [
    (r"\b(?:very|extremely|highly|incredibly|particularly|especially|really|truly)\s+", ""),
    (r"\bwork\s+(?:diligently|carefully|hard|tirelessly)\b", "work"),
    (r"\bcarefully\s+(?:analyze|consider|review|evaluate|examine)\b", ""),
    (r"\bthoroughly\s+(?:review|analyze|check|test|examine)\b", ""),
    (r"\brigorously\s+(?:evaluate|test|analyze|check)\b", ""),
    (r"\bconsistently\s+(?:applied|used|followed|enforced)\b", ""),
    (r"\bexplicitly\s+(?:stated|mentioned|noted|listed)\b", ""),
    (r"\bproactively\s+(?:alert|warn|notify|inform)\b", ""),
    (r"\bimmediately\s+actionable\b", "actionable"),
    (r"\bon\s+this\s+(?:topic|matter|issue|subject)\b", ""),
]

# Rules of the specification, in their order.
WHITESPACE_CLEANUP = [
    ("  +", " "),
    (" ,", ","),
    (r" \.", "."),
    (r"\.\.", "."),
    (r"(?m)^\s+", ""),
    (r"\. \.", "."),
]

# Rules of the specification, in their order.
CONVERSATIONAL_STRIP = [
    (r"\bI'?d\s+like\s+you\s+to\b", ""),
    (r"\bcould\s+you\s+please\b", ""),
    (r"\bwould\s+you\s+please\b", ""),
    (r"\bcan\s+you\s+please\b", ""),
    (r"\bI\s+want\s+you\s+to\b", ""),
    (r"\bI\s+need\s+you\s+to\b", ""),
    (r"\bI'?m\s+asking\s+you\s+to\b", ""),
    (r"\bwhat\s+I\s+want\s+is\s+for\s+you\s+to\b", ""),
    (r"\bif\s+possible\s*,?\b", ""),
    (r"\bif\s+you\s+can\s*,?\b", ""),
    (r"\bwhen\s+possible\s*,?\b", ""),
    (r"\bwhere\s+possible\s*,?\b", ""),
    (r"\bto\s+the\s+extent\s+possible\s*,?\b", ""),
    (r"\bthis\s+is\s+very\s+important\s*[.!]?\b", ""),
    (r"\bthis\s+is\s+critical\s*[.!]?\b", ""),
    (r"\bpay\s+close\s+attention\s+to\s+this\b", ""),
    (r"\bthis\s+is\s+a\s+key\s+point\b", ""),
    (r"\bprovide\s+(?:detailed|comprehensive|thorough)\s+(?:explanations?|responses?|analysis)\b", "explain thoroughly"),
    (r"\bprovide\s+(?:clear|concise|helpful)\s+(?:explanations?|responses?|information)\b", "explain clearly"),
    (r"\bconsider\s+the\s+(?:broader|wider|overall|general)\s+(?:context|picture|implications?)\b", "consider context"),
    (r"\bthat\s+(?:can|could|may|might|would)\s+be\s+(?:easily\s+)?understood\s+by\b", "for"),
    (r"\brecognizing\s+that\b", "since"),
    (r"\bgiven\s+the\s+fact\s+that\b", "since"),
    (r"\bconsidering\s+the\s+fact\s+that\b", "since"),
    (r"\bdistinguish\s+between\b", "separate"),
    (r"\bprioritize\s+the\s+most\s+(?:critical|important)\b", "prioritize"),
    (r"\byou\s+are\s+(?:a|an)\s+(?:experienced|expert|knowledgeable|skilled|seasoned|senior)\b", "you are a"),
    (r"\bwith\s+(?:over\s+)?\d+\s+years?\s+of\s+(?:experience|expertise)(?:\s+in\s+(?:the\s+)?field)?\b", ""),
    (r"\byour\s+(?:role|job|task)\s+is\s+to\s+(?:help|assist|aid|support)\b", "help"),
    (r"\b(?:individuals|people|users|clients|customers)\s+(?:understand|learn|comprehend)\b", "users understand"),
    (r"\bprovide\s+(?:personalized|tailored|custom)\s+(?:recommendations?|suggestions?|guidance|advice)\b", "recommend"),
    (r"\bprovide\s+(?:practical|useful|helpful|actionable)\s+(?:tips?|advice|guidance|suggestions?|information)\b", "advise"),
    (r"\bmake\s+(?:informed|better|good|sound)\s+decisions?\b", "decide well"),
    (r"\bhelp\s+(?:them|users?|clients?|customers?)\s+(?:understand|learn|make\s+sense\s+of)\b", "explain"),
    (r"\bshould\s+not\s+be\s+(?:used\s+as|considered)\s+(?:a\s+)?(?:substitute|replacement)\s+for\s+(?:professional\s+)?\b", "is not a substitute for "),
    (r"\bfor\s+(?:educational|informational)\s+purposes\s+only\b", "educational only"),
    (r"\bnot\s+(?:be\s+)?considered\s+(?:as\s+)?(?:personalized\s+)?(?:professional\s+)?(?:financial|legal|medical|tax)\s+advice\b", "not professional advice"),
    (r"\b(?:consult|speak)\s+with\s+(?:a\s+)?(?:qualified|licensed|certified)?\s*(?:professional|advisor|attorney|doctor|specialist|expert)\s+before\b", "consult a professional before"),
    (r"\bensure\s+(?:that\s+)?all\s+(?:examples|information|data|responses?)\s+(?:are|is)\s+(?:accurate|correct|up-to-date)\b", "be accurate"),
    (r"\b(?:maintain|keep)\s+(?:a\s+)?(?:professional|respectful|friendly|positive)\s+(?:tone|demeanor|attitude|approach)\b", "be professional"),
    (r"\bshould\s+not\s+be\s+(?:considered|used)\s+as\s+(?:a\s+substitute\s+for|replacement\s+for|personalized)\b", "is not"),
    (r"\bshould\s+consult\s+with\s+(?:a|their|an?)\s+(?:qualified|licensed|professional)\b", "should consult"),
    (r"\.\s*(?:Always|Ensure|Make sure)\s+", ". "),
    (r",\s*recognizing\s+that\s+[^.]{10,60}\.\s*", ". "),
    (r",\s*understanding\s+that\s+[^.]{10,60}\.\s*", ". "),
    (r",\s*keeping\s+in\s+mind\s+that\s+[^.]{10,60}\.\s*", ". "),
]

# Rules of the specification, in their order.
AI_OUTPUT_NOISE = [
    (r"\bas\s+an?\s+AI\s+(?:language\s+)?model\s*,?\s*(?:I\s+)?", ""),
    (r"\bas\s+an?\s+(?:artificial\s+intelligence|AI)\s*,?\s*", ""),
    (r"\bas\s+a\s+(?:large\s+)?language\s+model\s*,?\s*(?:I\s+)?", ""),
    (r"\bI\s+(?:am|'m)\s+sorry\s+for\s+(?:the|any)\s+confusion\s*[.,]?\s*", ""),
    (r"\bI\s+apologize\s+for\s+(?:the|any)\s+confusion\s*[.,]?\s*", ""),
    (r"\bsorry\s+(?:about|for)\s+(?:the|that|any)\s+(?:confusion|misunderstanding)\s*[.,]?\s*", ""),
    (r"\bI\s+apologize\s+for\s+(?:the|my)\s+oversight\s*[.,]?\s*", ""),
    (r"\bI\s+(?:am|'m)\s+sorry\s+for\s+(?:the|my)\s+oversight\s*[.,]?\s*", ""),
    (r"\bmy\s+apologies\s+for\s+(?:the|that|any)\s+(?:oversight|mistake|error)\s*[.,]?\s*", ""),
    (r"\bhowever\s*,?\s*it'?s?\s+important\s+to\s+(?:consider|note|remember|keep\s+in\s+mind)\b", "Note:"),
    (r"\bit'?s?\s+worth\s+(?:noting|mentioning|considering)\s+that\b", "Note:"),
    (r"\bit'?s?\s+important\s+to\s+(?:keep\s+in\s+mind|understand|recognize)\s+that\b", "Note:"),
    (r"\bI\s+cannot\s+provide\s+.*?,\s*but\s+I\s+can\b", "Instead, I can"),
    (r"\bI'?m\s+(?:not\s+able|unable)\s+to\s+.*?,\s*(?:but|however)\s*,?\s*", ""),
    (r"\blet\s+me\s+know\s+if\s+you\s+need\s+any\s+(?:further|more|additional)\s+(?:help|assistance|information|clarification)\s*[.!]?\s*", ""),
    (r"\bdon'?t\s+hesitate\s+to\s+(?:ask|reach\s+out)\s*[.!]?\s*", ""),
    (r"\bI\s+hope\s+this\s+helps\s*[.!]?\s*", ""),
    (r"\bhope\s+(?:this|that)\s+(?:helps|is\s+helpful)\s*[.!]?\s*", ""),
    (r"\bfeel\s+free\s+to\s+ask\s+if\s+you\s+have\s+(?:any\s+)?(?:more|other|further|additional)\s+questions?\s*[.!]?\s*", ""),
    (r"\bif\s+you\s+have\s+any\s+(?:other|more|further)\s+questions?\s*,?\s*(?:feel\s+free\s+to\s+ask|let\s+me\s+know)\s*[.!]?\s*", ""),
    (r"\bplease\s+keep\s+in\s+mind\s+that\b", "note:"),
    (r"\bkeep\s+in\s+mind\s+that\b", "note:"),
    (r"\bit\s+depends\s+on\s+(?:various|many|several|a\s+number\s+of)\s+factors\b", "it varies"),
    (r"\bthere\s+are\s+(?:many|several|various)\s+(?:factors|considerations)\s+(?:to\s+)?(?:consider|keep\s+in\s+mind)\b", "it varies"),
]

# Rules of the specification, in their order.
MARKDOWN_MINIFICATION = [
    (r"(?m)^#{4,6}\s+", "# "),
    (r"(?m)^###\s+", "## "),
    (r"(?m)^(?:>\s*){2,}", "> "),
    (r"!\[\s*\]\(([^)]+)\)", "$1"),
    (r"!\[image\]\(([^)]+)\)", "$1"),
    (r"(?m)^(\s*)[*+]\s+", "$1- "),
    (r"\*{2}([^*]+)\*{2}", "$1"),
    (r"(?<!\*)\*(?!\*)([^*]+)(?<!\*)\*(?!\*)", "$1"),
    (r"\|\s{2,}", "| "),
    (r"\s{2,}\|", " |"),
    (r"<br\s*/?\s*>", "\n"),
    ("</?(?:b|strong)>", ""),
    ("</?(?:i|em)>", ""),
    ("</?(?:p|div|span)>", ""),
    (r"(?m)^\s*(?:---+|___+|\*\*\*+)\s*$", ""),
    (r"\[(?:Read\s+(?:this|more|the)\s+(?:documentation|docs|here|article))\]\(([^)]+)\)", "$1"),
    (r"(?i)\[(?:click\s+here|here|link)\]\(([^)]+)\)", "$1"),
    (r"```(?:python|javascript|typescript|bash|shell|sh|json|yaml|yml|xml|html|css|sql|java|go|rust|ruby|php|c|cpp|csharp|swift|kotlin)\s*\n", "```\n"),
]

# Rules of the specification, in their order.
SOURCE_CODE_COMPRESSION = [
    (r"(?m)^\s*//(?!\s*TODO)[^\n]{2,}$", ""),
    (r"(?m)^\s*#\s+(?!TODO|!|\s*$)[^\n]{3,}$", ""),
    (r"(?s)/\*(?!\*/).*?\*/", ""),
    ("(?s)\"{3}(?!.*(?:TODO|FIXME|NOTE)).*?\"{3}", ""),
    ("(?s)'{3}(?!.*(?:TODO|FIXME|NOTE)).*?'{3}", ""),
    (r"(?m)^\s*\n(?=\s*\n)", ""),
    (r",\s*([}\]])", "$1"),
    (r":\s+(\d)", ":$1"),
    (r";\s+", ";"),
    (r"\{\s+", "{"),
    (r"\s+\}", "}"),
]

# Rules of the specification, in their order.
CONTEXT_DEDUPLICATION = [
    (r"(?m)^(?:Thanks!?|Thank you!?|Got it!?|That worked!?|OK!?|Okay!?|Great!?|Perfect!?|Understood!?)\s*$", ""),
    ("data:[a-zA-Z/]+;base64,[A-Za-z0-9+/=]{100,}", "[BASE64_TRUNCATED]"),
    (r"\b[A-Za-z0-9+/]{500,}={0,2}", "[BASE64_TRUNCATED]"),
    (r"(?i)\bI\s+will\s+(?:look\s+into|work\s+on|get\s+(?:back\s+to|on))\s+(?:this|that)\s+(?:right\s+now|immediately|shortly)\s*[.!]?\s*", ""),
    (r"(?i)\bLet\s+me\s+(?:check|look\s+into|investigate)\s+(?:this|that)\s+for\s+you\s*[.!]?\s*", ""),
]

# Rules of the specification, in their order.
SEMANTIC_FORMATTING = [
    (r"\bforty[\s-]two\s+thousand\b", "42k"),
    (r"\bten\s+thousand\b", "10k"),
    (r"\bone\s+hundred\s+thousand\b", "100k"),
    (r"\bone\s+million\b", "1M"),
    (r"\btwo\s+million\b", "2M"),
    (r"\bone\s+billion\b", "1B"),
    (r"\bone\s+hundred\b", "100"),
    (r"\btwo\s+hundred\b", "200"),
    (r"\bfive\s+hundred\b", "500"),
    (r"\bone\s+thousand\b", "1k"),
    (r"(?m)^First\s*,\s*", "1. "),
    (r"(?m)^Second\s*,\s*", "2. "),
    (r"(?m)^Third\s*,\s*", "3. "),
    (r"(?m)^Fourth\s*,\s*", "4. "),
    (r"(?m)^Fifth\s*,\s*", "5. "),
    (r"[?&]utm_\w+=[^&\s)]*", ""),
    (r"[?&](?:ref|source|campaign|medium|fbclid|gclid|mc_[a-z]+)=[^&\s)]*", ""),
    (r"\bdo\s+not\b", "don't"),
    (r"\bcannot\b", "can't"),
    (r"\bwill\s+not\b", "won't"),
    (r"\bshould\s+not\b", "shouldn't"),
    (r"\bwould\s+not\b", "wouldn't"),
    (r"\bcould\s+not\b", "couldn't"),
    (r"\bdoes\s+not\b", "doesn't"),
    (r"\bdid\s+not\b", "didn't"),
    (r"\bis\s+not\b", "isn't"),
    (r"\bare\s+not\b", "aren't"),
    (r"\bwas\s+not\b", "wasn't"),
    (r"\bwere\s+not\b", "weren't"),
    (r"\bhas\s+not\b", "hasn't"),
    (r"\bhave\s+not\b", "haven't"),
    (r"\bhad\s+not\b", "hadn't"),
    (r"\b([A-Z]\w+)\s+and\s+([A-Z]\w+)\b", "$1 & $2"),
]

# Rules of the specification, in their order.
ANTI_NOISE = [
    (r"(?:[A-Z]:\\(?:Users|Program Files)\\[^\s]*\\)", ".../"),
    (r"/(?:home|usr|var|opt)/[^\s/]+(?:/[^\s/]+){2,}/", ".../"),
    (r"/node_modules/[^\s]+/", "[node_modules]/ "),
    (r"\b([0-9a-f]{8})-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "$1-..."),
    (r"\x1b\[[0-9;]*m", ""),
    (r"\\x1b\[[0-9;]*m", ""),
    (r"(?m)(^.{30,}$)\n(?:\1\n){2,}+", "$1\n[repeated]\n"),
    (r"(?m)^\s+(?:at\s+)?(?:/node_modules/|/usr/lib/python|/usr/local/lib/|site-packages/).*$\n?", ""),
    (r"(?m)^\s+at\s+(?:internal/|node:).*$\n?", ""),
    (r"\b([0-9a-f]{7})[0-9a-f]{33}\b", "$1"),
    (r"\b([0-9a-f]{8})[0-9a-f]{24,}\b", "$1"),
    (r"(?i)\bdo\s+not\s+share\s+this\s+system\s+prompt\s+with\s+the\s+user\s*[.!]?\s*", ""),
    (r"(?i)\bnever\s+reveal\s+(?:your|these?|this)\s+(?:system\s+)?(?:prompt|instructions?)\s*[.!]?\s*", ""),
    (r"(?i)\bkeep\s+(?:this|these)\s+instructions?\s+(?:confidential|private|secret)\s*[.!]?\s*", ""),
    (r":\s*\{\s*\}", ": {}"),
    (r":\s*\[\s*\]", ": []"),
    (r"<thought>\s*</thought>", ""),
    (r"<thinking>\s*</thinking>", ""),
    (r"<scratchpad>\s*</scratchpad>", ""),
    (r"<inner_monologue>\s*</inner_monologue>", ""),
]

# Rules of the specification, in their order.
AGENT_METADATA = [
    (r"(?s)(?:user:\s*)?Conversation info \(untrusted metadata\):\s*```json\s*\{.*?\}\s*```\s*\n?", ""),
    (r'(?s)```json\s*\{\s*"message_id".*?\}\s*```\s*\n?', ""),
    (r"\[\[reply_to_current\]\]\s*", ""),
    (r"\[\[reply_to_[^\]]+\]\]\s*", ""),
    (r"\[\[[^\]]+\]\]\s*", ""),
    (r"(?s)# Session: \d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} UTC\n.*?## Conversation Summary\n+", ""),
    (r"(?m)^- \*\*Session Key\*\*:.*\n", ""),
    (r"(?m)^- \*\*Session ID\*\*:.*\n", ""),
    (r"(?m)^- \*\*Source\*\*:.*\n", ""),
    (r"(?m)^## Conversation Summary\s*\n", ""),
    (r"\[\w{2,4} \d{4}-\d{2}-\d{2} \d{2}:\d{2} UTC\]\s*", ""),
    (r"(?s)(?:user: )?A new session was started via /new or /reset\..*?what they want to do\.\s*\n?", ""),
    (r"(?s)(U: .{200,}?)\n+\1", "$1"),
    (r"(?m)^assistant:\s+", "A: "),
    (r"(?m)^user:\s+", "U: "),
    (r"\n{3,}", "\n\n"),
]

# Rules of the specification, in their order.
VERBOSE_PHRASES = [
    (r"\bmake\s+sure\s+to\b", "ensure"),
    (r"\btake\s+into\s+account\b", "consider"),
    (r"\btake\s+into\s+consideration\b", "consider"),
    (r"\bis\s+able\s+to\b", "can"),
    (r"\bare\s+able\s+to\b", "can"),
    (r"\bhas\s+the\s+ability\s+to\b", "can"),
    (r"\bhave\s+the\s+ability\s+to\b", "can"),
    (r"\bin\s+addition\s+to\b", "also"),
    (r"\ba\s+large\s+number\s+of\b", "many"),
    (r"\ba\s+significant\s+number\s+of\b", "many"),
    (r"\bthe\s+vast\s+majority\s+of\b", "most"),
    (r"\bthe\s+majority\s+of\b", "most"),
    (r"\bin\s+close\s+proximity\s+to\b", "near"),
    (r"\bin\s+the\s+vicinity\s+of\b", "near"),
    (r"\buntil\s+such\s+time\s+as\b", "until"),
    (r"\bduring\s+the\s+course\s+of\b", "during"),
    (r"\bon\s+a\s+daily\s+basis\b", "daily"),
    (r"\bon\s+a\s+regular\s+basis\b", "regularly"),
    (r"\bin\s+the\s+near\s+future\b", "soon"),
    (r"\bat\s+the\s+end\s+of\s+the\s+day\b", "ultimately"),
    (r"\bthe\s+fact\s+that\b", "that"),
    (r"\bin\s+light\s+of\b", "given"),
    (r"\bthere\s+is\s+a\s+need\s+to\b", "must"),
    (r"\bit\s+is\s+necessary\s+to\b", "must"),
    (r"\bit\s+is\s+recommended\s+that\b", "should"),
    (r"\bit\s+is\s+suggested\s+that\b", "should"),
    (r"\bit\s+is\s+advisable\s+to\b", "should"),
    (r"\byour\s+(?:primary\s+)?(?:role|responsibility|job|task)\s+is\s+to\b", ""),
    (r"\byour\s+goal\s+is\s+to\b", ""),
    (r"\byou\s+are\s+(?:designed|tasked|meant|intended)\s+to\b", ""),
    (r"\byou\s+are\s+responsible\s+for\b", "handle"),
    (r"\bin\s+your\s+(?:responses?|analysis|review|recommendations?)\b", ""),
    (r"\bin\s+your\s+(?:explanations?|feedback|suggestions?)\b", ""),
    (r"\bwhen\s+(?:possible|appropriate|applicable|relevant|necessary)\s*,?\b", ""),
    (r"\bwhere\s+(?:possible|appropriate|applicable|relevant|necessary)\s*,?\b", ""),
    (r"\bat\s+all\s+times\b", "always"),
    (r"\bif\s+you\s+are\s+(?:unable|not\s+able)\s+to\b", "if unable to"),
    (r"\bwhenever\s+possible\b", ""),
    (r"\bas\s+(?:needed|required|appropriate|necessary)\b", ""),
    (r"\bwhen\s+dealing\s+with\b", "for"),
    (r"\bwhen\s+working\s+with\b", "for"),
    (r"\bwhen\s+responding\s+to\b", "for"),
    (r"\bwhen\s+providing\b", "for"),
    (r"\bwhen\s+discussing\b", "for"),
    (r"\bwhen\s+reviewing\b", "for"),
    (r"\bwhen\s+analyzing\b", "for"),
    (r"\bwhen\s+explaining\b", "for"),
    (r"\bwhen\s+helping\b", "for"),
    (r"\bwhen\s+making\b", "for"),
    (r"\bthorough\s+and\s+comprehensive\b", "thorough"),
    (r"\bclear\s+and\s+concise\b", "concise"),
    (r"\baccurate\s+and\s+up[- ]to[- ]date\b", "current"),
    (r"\bhelpful\s+and\s+(?:friendly|supportive|informative)\b", "helpful"),
    (r"\bpolite\s*,?\s+professional\s*,?\s+and\s+(?:empathetic|courteous|respectful)\b", "professional"),
    (r"\brespectful\s+and\s+(?:educational|constructive|professional)\b", "constructive"),
    (r"\bclear\s*,?\s+(?:accessible|understandable)\b", "clear"),
    (r"\bpractical\s+and\s+(?:realistic|actionable|immediately\s+actionable)\b", "practical"),
    (r"\benthusiastic\s+and\s+(?:inspiring|supportive)\b", "enthusiastic"),
    (r"\bbalanced\s+and\s+(?:nuanced|objective|fair)\b", "balanced"),
    (r"\bpatient\s+and\s+(?:supportive|understanding|encouraging)\b", "patient"),
    (r"\balways\s+consider\s+the\b", "consider"),
    (r"\balways\s+remember\s+(?:that|to)\b", ""),
    (r"\balways\s+make\s+sure\b", "ensure"),
    (r"\balways\s+keep\s+in\s+mind\b", "note:"),
    (r"\bplease\s+be\s+(?:sure|careful|mindful)\s+to\b", ""),
    (r"\bplease\s+consider\b", "consider"),
    (r"\bplease\s+provide\b", "provide"),
    (r"\bplease\s+include\b", "include"),
    (r"\bplease\s+recommend\b", "recommend"),
    (r"\bplease\s+also\b", "also"),
    (r"\byou\s+should\s+also\b", "also"),
    (r"\byou\s+should\s+always\b", "always"),
    (r"\byou\s+should\s+never\b", "never"),
    (r"\bplease\s+always\b", "always"),
    (r"\bplease\s+never\b", "never"),
    (r"\bassist\s+(?:\w+\s+)?with\s+their\b", "help with"),
    (r"\bwork\s+diligently\s+to\b", ""),
    (r"\bwork\s+(?:closely|collaboratively)\s+with\b", "work with"),
    (r"\backnowledge\s+their\s+(?:frustration|concerns?)\s+and\b", "address concerns and"),
    (r"\blet\s+(?:the\s+)?(?:customer|user|client)\s+know\s+that\b", "inform them"),
    (r"\bstep-by-step\s+instructions\b", "steps"),
    (r"\bstep-by-step\s+(?:guide|process|procedure|explanation)\b", "steps"),
    (r"\bdocument\s+all\s+interactions\s+in\b", "log in"),
    (r"\bfor\s+their\s+patience\s+and\s+for\s+(?:choosing|using)\b", "for using"),
    (r"\bfor\s+their\s+patience\b", ""),
    (r"\bconsult\s+with\s+(?:a\s+)?(?:qualified|licensed)?\s*(?:their\s+)?\b", "consult "),
    (r"\bconsider\s+factors?\s+such\s+as\b", "consider"),
    (r"\bthis\s+includes?\s+(?:but\s+is\s+)?not\s+limited\s+to\b", "including"),
    (r"\bincluding\s+but\s+not\s+limited\s+to\b", "including"),
    (r"\bin\s+(?:a|the)\s+(?:clear|concise|timely|professional|detailed)\s+(?:manner|way|fashion)\b", "clearly"),
    (r"\bin\s+(?:a|the)\s+(?:friendly|helpful|supportive)\s+(?:manner|way|fashion)\b", "helpfully"),
    (r"\bon\s+behalf\s+of\s+the\b", "for the"),
    (r"\bwith\s+(?:a\s+)?focus\s+on\b", "focusing on"),
    (r"\bwith\s+(?:an\s+)?emphasis\s+on\b", "emphasizing"),
    (r"\bbased\s+on\s+(?:their|the\s+user'?s?)\s+(?:preferences?|needs?|requirements?)\b", "per their needs"),
    (r"\bbased\s+on\s+(?:your|the)\s+(?:analysis|assessment|evaluation|review)\b", "from your review"),
    (r"\bregardless\s+of\s+(?:whether|how|what)\b", "regardless"),
    (r"\birrespective\s+of\b", "regardless of"),
    (r"\beven\s+in\s+(?:the\s+)?(?:case|event|situation)\s+(?:of|where|that)\b", "even if"),
    (r"\bspecific(?:ally)?\s+(?:designed|intended|meant|tailored)\s+(?:for|to)\b", "for"),
    (r"\bspecifically\b", ""),
    (r"\bparticularly\b", ""),
    (r"\bespecially\b", ""),
    (r"\b(?:various|a\s+variety\s+of|different\s+types?\s+of|a\s+range\s+of|a\s+number\s+of)\b", "various"),
    (r"\b(?:all|any)\s+(?:relevant|applicable|appropriate|necessary|required)\b", "relevant"),
    (r"\b(?:relevant|applicable)\s+(?:laws?|regulations?|requirements?|standards?|guidelines?)\b", "regulations"),
    (r"\b(?:current|latest|up-to-date|most\s+recent)\s+(?:information|data|research|evidence|findings?)\b", "current data"),
    (r"\b(?:clear|detailed|thorough|comprehensive|in-depth)\s+explanation\b", "explanation"),
    (r"\b(?:clear|detailed|thorough|comprehensive|in-depth)\s+analysis\b", "analysis"),
    (r"\b(?:clear|detailed|thorough|comprehensive|in-depth)\s+(?:overview|summary)\b", "summary"),
    (r"\bbetter,\s+more\s+\w+,\s+and\s+more\s+(\w+)\b", "better, $1"),
    (r"\bmore\s+(\w+)\s+and\s+more\s+(\w+)\b", "$1 and $2"),
    (r"\bnot\s+just\s+(\w+)\s+but\s+(?:also\s+)?(\w+)\b", "$1 and $2"),
    (r"\bnot\s+only\s+(\w+)\s+but\s+(?:also\s+)?(\w+)\b", "$1 and $2"),
    (r"\bfor\s+both\s+the\s+(\w+)\s+and\s+the\s+(\w+)\b", "for $1 and $2"),
    (r"\bboth\s+(\w+)\s+and\s+(\w+)\b", "$1/$2"),
    (r"\b(ensure|verify|confirm|check|note)\s+that\b", "$1"),
    (r"\b(explain|mention|indicate|state|report)\s+that\b", "$1"),
    (r"\b(acknowledge|recognize|understand)\s+that\b", "$1"),
    (r"\b(know|remember|realize)\s+that\b", "$1"),
    (r"\bin\s+the\s+process\s+of\b", "while"),
    (r"\bwith\s+a\s+focus\s+on\b", "focusing on"),
    (r"\bon\s+the\s+basis\s+of\b", "based on"),
    (r"\bby\s+means\s+of\b", "via"),
    (r"\bin\s+the\s+absence\s+of\b", "without"),
    (r"\bfor\s+the\s+benefit\s+of\b", "for"),
    (r"\bwith\s+the\s+intention\s+of\b", "to"),
    (r"\bwork\s+diligently\s+to\b", ""),
    (r"\bwork\s+hard\s+to\b", ""),
    (r"\bdo\s+your\s+best\s+to\b", ""),
    (r"\bto\s+the\s+best\s+of\s+your\s+(?:ability|abilities|knowledge)\b", ""),
]

# Rules of the specification, in their order.
DEVELOPER_BOILERPLATE = [
    (r"\bact\s+as\s+a\s+senior\s+(?:developer|engineer|programmer)\s+who\s+is\s+an?\s+expert\s+in\b", "Expert:"),
    (r"\bact\s+as\s+(?:a|an)\s+experienced\b", "Expert"),
    (r"\bact\s+as\s+(?:a|an)\s+(?:senior|expert|professional)\b", "Expert"),
    (r"\bthink\s+step\s+by\s+step\s+and\s+carefully\s+analyze\b", "Step by step:"),
    (r"\blet'?s?\s+think\s+(?:about\s+this\s+)?step\s+by\s+step\b", "Step by step:"),
    (r"\bthink\s+through\s+this\s+carefully\b", "Step by step:"),
    (r"\btake\s+a\s+deep\s+breath\s+and\s+(?:give\s+me\s+your\s+best|work\s+through\s+this)\b", ""),
    (r"\btake\s+a\s+deep\s+breath\b", ""),
    (r"\byou\s+are\s+the\s+best\s+at\s+this\b", ""),
    (r"\byou\s+are\s+an\s+expert\s+at\s+this\b", ""),
    (r"\byour\s+task\s+is\s+to\b", "Task:"),
    (r"\byour\s+job\s+is\s+to\b", "Task:"),
    (r"\byour\s+goal\s+is\s+to\b", "Goal:"),
    (r"\byour\s+objective\s+is\s+to\b", "Goal:"),
    (r"\byou\s+are\s+an?\s+AI\s+assistant\s+designed\s+to\b", "Assistant:"),
    (r"\byou\s+are\s+an?\s+AI\s+(?:language\s+)?model\s+(?:designed|trained|built)\s+to\b", "Assistant:"),
    (r"\byou\s+are\s+a\s+helpful\s+(?:AI\s+)?assistant\s+(?:that|who|designed\s+to)\b", "Assistant:"),
    (r"\bfollow\s+these\s+instructions\s+carefully\s*:\s*", "Instructions: "),
    (r"\bhere\s+are\s+(?:the|your|my)\s+instructions\s*:\s*", "Instructions: "),
    (r"\bbelow\s+are\s+(?:the|your)\s+instructions\s*:\s*", "Instructions: "),
    (r"\bI\s+want\s+you\s+to\s+write\s+(?:a|an)\s+(?:program|script|function)\s+that\b", "Program:"),
    (r"\bwrite\s+(?:a|an)\s+(?:program|script|function)\s+that\b", "Program:"),
    (r"\bmake\s+sure\s+the\s+code\s+is\s+production[\s-]ready\s+and\s+optimized\b", "Production ready."),
    (r"\bensure\s+the\s+code\s+is\s+(?:clean|efficient|optimized|well[\s-]structured)\s+and\b", "Clean code."),
    (r"\bdo\s+not\s+include\s+any\s+explanations?\s*,?\s*just\s+(?:the\s+)?code\b", "Only code."),
    (r"\bonly\s+(?:respond|reply|output)\s+with\s+(?:the\s+)?code\b", "Only code."),
    (r"\bno\s+explanations?\s+needed\b", "Only code."),
    (r"\bCRITICAL\s+INSTRUCTION\s*:", "CRITICAL:"),
    (r"\bIMPORTANT\s+NOTE\s*:", "NOTE:"),
    (r"\bPLEASE\s+NOTE\s+THE\s+FOLLOWING\s*:", "NOTE:"),
    (r"\bIMPORTANT\s+INSTRUCTION\s*:", "IMPORTANT:"),
]

# Rules of the specification, in their order.
ADJECTIVE_COLLAPSE = [
    (r"\b(better|improved|higher-quality),?\s+more\s+\w+,?\s+and\s+more\s+\w+\s+(\w+)\b", "$1 $2"),
    (r"\bclear,?\s+comprehensive,?\s+and\s+legally\s+compliant\b", "clear, compliant"),
    (r"\bclear,?\s+accessible\s+language\s+that\s+can\s+be\s+(?:easily\s+)?understood\s+by\s+[^.]+(?=\.)", "clear language"),
    (r"\baccurate,?\s+evidence-based\s+(\w+)\s+information\s+in\s+a\s+clear\s+and\s+educational\s+format\b", "evidence-based $1 info"),
    (r"\bsimple,?\s+easy-to-understand\s+terms?\s+while\s+(?:still\s+)?maintaining\s+technical\s+accuracy\b", "simple but accurate terms"),
    (r"\brespectful\s+and\s+educational\s+in\s+(?:your|the)\s+\w+,?\s*", ""),
    (r"\btechnical\s+issues,?\s+billing\s+questions,?\s+and\s+product\s+inquiries\b", "technical/billing/product issues"),
    (r"\bpotential\s+bugs,?\s+security\s+vulnerabilities,?\s+performance\s+bottlenecks,?\s+code\s+style\s+issues,?\s+and\s+opportunities\s+for\s+refactoring\b", "bugs/security/perf/style/refactoring"),
    (r"\berror\s+handling,?\s+edge\s+cases,?\s+input\s+validation,?\s+and\s+resource\s+management\b", "errors/edge-cases/validation/resources"),
    (r"\bcomputational\s+costs,?\s+latency\s+requirements,?\s+and\s+(?:model\s+)?interpretability\s+needs\b", "cost/latency/interpretability"),
    (r"\b(?:proper\s+)?experiment\s+design,?\s+cross-validation\s+techniques,?\s+feature\s+engineering\s+approaches,?\s+and\s+model\s+evaluation\s+metrics\b", "experiment design/CV/features/evaluation"),
    (r"\b(\w+),?\s+(\w+),?\s+and\s+(\w+)\s+(issues?|concerns?|requirements?|considerations?|problems?)\b", "$1/$2/$3 $4"),
    (r"\bstep-by-step\s+instructions\b", "steps"),
    (r"\bpractical\s+examples\s+and\s+real-world\s+use\s+cases\b", "examples"),
    (r"\bconcrete\s+code\s+examples\s+showing\s+the\s+recommended\s+changes\b", "code examples"),
    (r"\b(?:clear|detailed)\s+(?:explanations?|commentary)\s+(?:on|that|for)\b", "explaining"),
    (r"\b(?:the\s+)?mathematical\s+intuition\s+behind\s+them\b", "the intuition"),
]

# Rules of the specification, in their order.
CLAUSE_SIMPLIFY = [
    (r"\bthat\s+explains\s+not\s+(?:just|only)\s+(\w+)(?:\s+should\s+be\s+\w+)?\s+but\s+(?:also\s+)?(\w+)\b", "explaining $1 and $2"),
    (r",?\s*recognizing\s+that\s+[^.]{10,80}(?=\.)", ""),
    (r"\band\s+work\s+(?:diligently|hard|carefully|tirelessly)\s+to\s+resolve\s+(?:their|the|these)\s+issues?\b", "and resolve them"),
    (r"\bwithout\s+getting\s+overly\s+\w+\b", "concisely"),
    (r"\bhelp\s+\w+\s+make\s+the\s+most\s+of\s+their\s+(\w+)\b", "maximize their $1"),
    (r"\bwhile\s+(?:remaining|staying|being)\s+\w+\s+and\s+\w+\b", ""),
    (r"\bthat\s+will\s+help\s+\w+\s+(\w+)\b", "to $1"),
    (r"\bbefore\s+making\s+any\s+(?:decisions?|changes?|modifications?)\b", "first"),
    (r"\bbased\s+on\s+(?:their|the)\s+(?:preferences,?\s+)?(?:budget,?\s+)?(?:and\s+)?(?:travel\s+style|needs|requirements|goals)\b", "per preferences"),
    (r"\bsaving,?\s+investing,?\s+budgeting,?\s+and\s+planning\s+for\s+retirement\b", "personal finance"),
    (r"\bdiversity,?\s+equity,?\s+and\s+inclusion\s*(?:principles)?\b", "DEI"),
    (r"\bbenefits,?\s+risks,?\s+and\s+(?:alternatives|side\s+effects)\b", "tradeoffs"),
    (r"\bwhile\s+(?:still\s+)?(?:maintaining|ensuring|preserving)\s+(\w+(?:\s+\w+)?)\b", "(keep $1)"),
    (r"\bwithout\s+(?:being|becoming)\s+(?:too|overly)\s+\w+\b", ""),
    (r"\bfor\s+both\s+the\s+\w+\s+and\s+the\s+\w+\b", ""),
    (r"\bnot\s+(?:just|only)\s+(\w+(?:\s+\w+)?)\s+but\s+(?:also\s+)?(\w+)\b", "$1 and $2"),
    (r"\ba\s+learning\s+(?:opportunity|experience)\s+for\s+[^.]+?(?=\.)", "a learning opportunity"),
    (r"\bwho\s+will\s+follow\s+up\s+within\s+(\w+(?:\s+\w+)?)\b", "(follow-up $1)"),
    (r"\blet\s+the\s+(\w+)\s+know\s+that\b", "tell $1"),
    (r"\bto\s+illustrate\s+(?:your|the)\s+points?\b", ""),
    (r"\bin\s+(?:your|the)\s+(?:teaching|mentoring|coaching|advising)\s+approach\b", ""),
]

# Categories whose patterns ignore case.
FOLDED = ("filler_phrases", "imperative_conversions", "clause_collapse", "credential_strip", "disclaimer_collapse", "adverb_strip", "conversational_strip", "ai_output_noise", "semantic_formatting", "verbose_phrases", "developer_boilerplate", "adjective_collapse", "clause_simplify")
_TABLES = {
    "filler_phrases": FILLER_PHRASES, "imperative_conversions": IMPERATIVE_CONVERSIONS, "clause_collapse": CLAUSE_COLLAPSE, "credential_strip": CREDENTIAL_STRIP,
    "disclaimer_collapse": DISCLAIMER_COLLAPSE, "adverb_strip": ADVERB_STRIP, "whitespace_cleanup": WHITESPACE_CLEANUP,
    "conversational_strip": CONVERSATIONAL_STRIP, "ai_output_noise": AI_OUTPUT_NOISE, "markdown_minification": MARKDOWN_MINIFICATION, "source_code_compression": SOURCE_CODE_COMPRESSION,
    "context_deduplication": CONTEXT_DEDUPLICATION, "semantic_formatting": SEMANTIC_FORMATTING, "anti_noise": ANTI_NOISE, "agent_metadata": AGENT_METADATA,
    "verbose_phrases": VERBOSE_PHRASES, "developer_boilerplate": DEVELOPER_BOILERPLATE, "adjective_collapse": ADJECTIVE_COLLAPSE, "clause_simplify": CLAUSE_SIMPLIFY,
}


def rules(category: str) -> list[tuple[str, str]]:
    """``(pattern, replacement)`` of a category, in order."""
    return _TABLES[category]


CATEGORIES = tuple(_TABLES)

# Thresholds of each profile at which a category fires.
THRESHOLDS = {
    "aggressive": dict(filler_phrases=0.2, verbose_phrases=0.2, imperative_conversions=0.5, clause_collapse=0.5, developer_boilerplate=0.5, semantic_formatting=0.5, credential_strip=0.5, whitespace_cleanup=0.5, conversational_strip=0.8, ai_output_noise=0.8, markdown_minification=0.8, source_code_compression=0.8, context_deduplication=0.8, anti_noise=0.8, disclaimer_collapse=0.8, adjective_collapse=0.8, clause_simplify=0.8, adverb_strip=0.8, telegraph=0.5, code_minify=0.8, format_optimize=0.8),
    "balanced": dict(filler_phrases=0.2, verbose_phrases=0.2, imperative_conversions=0.5, clause_collapse=0.5, developer_boilerplate=0.5, semantic_formatting=0.5, credential_strip=0.5, whitespace_cleanup=0.5, conversational_strip=0.8, ai_output_noise=0.8, markdown_minification=0.8, source_code_compression=0.8, context_deduplication=0.8, anti_noise=0.8, disclaimer_collapse=0.8, adjective_collapse=0.9, clause_simplify=0.9, adverb_strip=0.9, telegraph=0.6, code_minify=0.8, format_optimize=0.8),
    "conservative": dict(filler_phrases=0.2, verbose_phrases=0.3, imperative_conversions=0.6, clause_collapse=0.7, developer_boilerplate=0.5, semantic_formatting=0.6, credential_strip=0.5, whitespace_cleanup=0.5, conversational_strip=0.9, ai_output_noise=0.8, markdown_minification=0.9, source_code_compression=0.9, context_deduplication=0.8, anti_noise=0.9, disclaimer_collapse=0.9, adjective_collapse=1.1, clause_simplify=1.1, adverb_strip=1.1, telegraph=0.8, code_minify=0.9, format_optimize=0.9),
}
# How much of a level each profile gives to sentences.
INTENSITY = {"aggressive": 1.0, "balanced": 0.85, "conservative": 0.6}
