"""The built-in taxonomy and retention policy.

Fixed values: the order of categories, of keywords and of markers decides which
rule wins, so every list stays in this order. Another taxonomy or policy can be
loaded from a file, see ``filewright.config``.
"""

# Markers that decide alone: (pattern over the flat name, category, reason).
MARKERS = [
    (r"\bimm\d{4,}\w*", "Canadian_PR_Docs", "IMM form number in filename"),
    (r"\bircc\b", "Canadian_PR_Docs", "IRCC marker in filename"),
    (r"\bielts\b", "Canadian_PR_Docs", "IELTS marker in filename"),
    (r"\bwes\b", "Canadian_PR_Docs", "WES (credential evaluation) marker"),
    (r"\bnoc\d*\b", "Canadian_PR_Docs", "NOC code in filename"),
    (r"\blmia\b", "Canadian_PR_Docs", "LMIA marker in filename"),
    (r"\bpcc\b", "Canadian_PR_Docs", "PCC (Police Clearance) marker"),
    (r"\beca\b", "Canadian_PR_Docs", "ECA (credential evaluation) marker"),
    (r"\bita\b", "Canadian_PR_Docs", "ITA (Invitation to Apply) marker"),
    (r"\bt4\b", "Canadian_PR_Docs", "T4 (Canadian tax form) used as PR proof"),
    (r"\bexpress entry\b", "Canadian_PR_Docs", "Express Entry reference"),
    (r"\bemployment verification\b", "Canadian_PR_Docs", "Employment verification letter (PR proof)"),
    (r"\bpolice clearance\b", "Canadian_PR_Docs", "Police clearance certificate"),
    (r"\bpermanent resident\b", "Canadian_PR_Docs", "Permanent resident document"),
    (r"^pr\b", "Canadian_PR_Docs", "Filename prefix 'PR_' indicates PR document"),
    (r"\bresignation\b", "Employment_Records", "Resignation letter (employee's own HR record)"),
    (r"\boffer of employment\b", "Employment_Records", "Offer of employment"),
    (r"\boffer letter\b", "Employment_Records", "Offer letter"),
    (r"\brelieving letter\b", "Employment_Records", "Relieving letter"),
    (r"\bexperience (letter|certificate)\b", "Employment_Records", "Experience certificate"),
    (r"\bservice certificate\b", "Employment_Records", "Service certificate"),
    (r"\binternational transfer\b", "Employment_Records", "International transfer letter"),
    (r"\bflex work\b", "Employment_Records", "Flex work letter (HR record, not work product)"),
    (r"\b(offboarding|onboarding) (checklist|pack|document)\b", "Employment_Records",
     "Onboarding/offboarding paperwork"),
    (r"\brecovery codes\b", "Credentials_Secrets", "2FA recovery codes"),
    (r"\baccess ?keys?\b", "Credentials_Secrets", "Access keys"),
    (r"\bid rsa\b", "Credentials_Secrets", "Private SSH key"),
    (r"\bcan (first )?pay slip\b", "Canadian_PR_Docs", "Canadian pay slip used as PR proof"),
    (r"\bpay ?slip\b", "Financial_Taxes", "Pay slip"),
    (r"\bbalance certificate\b", "Financial_Taxes", "Bank balance certificate"),
    (r"^xl[a-z]{1,2} csv$", "AstroQuant_Sidereal", "Sector ETF ticker OHLC export"),
    (r"^(nfty|nifty|banknifty|spy|qqq) csv$", "AstroQuant_Sidereal", "Index ticker OHLC export"),
]

CATEGORIES = {
    "Canadian_PR_Docs": {
        "extensions": [".pdf", ".docx", ".jpg", ".png"],
        "keywords": [
            "ircc", "express entry", "ita", "ielts", "wes", "visa", "pr", "work permit", "study permit",
            "immigration", "eca", "noc", "lmia", "pcc", "t4", "employment verification",
            "police clearance", "permanent resident", "imm5476e", "imm5787", "imm5790", "imm5791",
            "imm5786", "imm10003", "imm5644e",
        ],
    },
    "AstroQuant_Sidereal": {
        "extensions": [".csv", ".xlsx", ".json", ".py", ".ipynb", ".txt", ".md", ".html", ".zip", ".docx", ".gz"],
        "keywords": [
            "astro", "astrocycle", "quant", "backtest", "trading", "stocks", "nifty", "banknifty", "nfty",
            "ephemeris", "planet", "sidereal", "celestial", "cosmic", "vedic", "sequencer",
            "ticker signal", "strategy", "ohlc", "signals", "candles", "market", "finance", "xlb", "xlc",
            "xle", "xlf", "xli", "xlk", "xlp", "xlre", "xlu", "xlv", "xly",
        ],
    },
    "Guidewire_PSE_Work": {
        "extensions": [".txt", ".log", ".xml", ".json", ".csv", ".pdf", ".docx", ".pptx", ".md"],
        "keywords": [
            "guidewire", "gw", "jira", "salesforce", "sfdc", "claimcenter", "policycenter",
            "billingcenter", "support", "production", "uat", "ticket", "bug", "defect", "stacktrace",
            "log", "logs", "acceptable use", "enterprise policy", "okta", "zurichci", "liberty-corp",
            "uplift", "jutro", "aviva",
        ],
    },
    "Employment_Records": {
        "extensions": [".pdf", ".docx", ".eml", ".msg", ".txt"],
        "keywords": [
            "offer of employment", "offer letter", "employment agreement", "employment contract",
            "international transfer", "transfer letter", "flex work", "relieving letter",
            "experience letter", "experience certificate", "service certificate", "resignation",
            "onboarding", "offboarding", "background check", "last working day", "notice period",
            "separation", "exit formalities", "appraisal", "performance review", "promotion",
            "compensation review", "salary revision", "rsu", "stock options", "equity grant",
        ],
    },
    "Certifications_Training": {
        "extensions": [".pdf", ".png", ".jpg"],
        "keywords": [
            "certificate", "certification", "certified", "ckad", "cka", "coursera", "udemy",
            "course completion", "training completion", "accreditation",
        ],
    },
    "Credentials_Secrets": {
        "extensions": [".txt", ".csv", ".json", ".pem", ".key", ".p12", ".pfx", ".keystore", ".cer"],
        "keywords": [
            "recovery codes", "access key", "accesskeys", "credentials", "password", "passphrase",
            "secret", "apikey", "api key", "keystore", "truststore", "private key", "id_rsa",
        ],
    },
    "Customer_Data": {
        "extensions": [".xml", ".json", ".csv"],
        "keywords": [
            "customer metadata", "customer-metadata", "saml", "idp", "sso", "identity provider",
            "service provider", "tenant",
        ],
    },
    "Resumes_Career_Tech": {
        "extensions": [".pdf", ".docx", ".pptx"],
        "keywords": [
            "resume", "cv", "interview", "cover letter", "portfolio", "software engineer", "developer",
            "sde", "linkedin",
        ],
    },
    "Financial_Taxes": {
        "extensions": [".pdf", ".csv"],
        "keywords": [
            "hdfc", "acct", "statement", "bank", "emi", "receipt", "pay slip", "balance certificate",
            "balancecertificate", "billedstatements", "bill", "voucher", "invoice", "credit card", "jio",
            "tax", "taxes", "tax forms", "income tax", "notice of assessment", "proof of income",
            "payslip", "payslips", "salary",
        ],
    },
    "Medical_Health": {
        "extensions": [".pdf", ".docx", ".jpg", ".eml"],
        "keywords": [
            "medical", "doctor", "health", "clinic", "hospital", "prescription", "hives", "ulticaria",
            "urticaria", "follow up",
        ],
    },
    "Travel_Transit": {
        "extensions": [".pdf", ".jpg", ".png"],
        "keywords": [
            "indigo", "air india", "itinerary", "ticket", "flight", "boarding", "boarding pass", "hotel",
            "reservation", "octave",
        ],
    },
    "Franchise_Business_Research": {
        "extensions": [".pdf", ".docx", ".html", ".zip"],
        "keywords": ["franchise", "reality flip", "market evaluation", "facility report", "due diligence"],
    },
    "Media_Images": {
        "extensions": [".jpg", ".jpeg", ".png", ".gif", ".mp4", ".mov"],
        "keywords": ["screenshot", "screencapture", "image", "photo", "pxl", "img"],
    },
    "Archives_and_Apps": {
        "extensions": [".zip", ".tar", ".gz", ".dmg", ".pkg", ".exe"],
        "keywords": ["installer", "app", "setup"],
    },
    "System_Junk": {
        "extensions": [".ds_store", ".tmp", ".cache", ".localized", ".cer"],
        "keywords": ["gitignore"],
    },
    "Unknown_Unsorted": {"extensions": [], "keywords": []},
}

SETTINGS = {
    "confidence_threshold": 60,
    "max_extract_chars": 1500,
    "models": {"ai-small": "qwen2.5:7b", "ai-large": "qwen2.5:14b"},
    "default_local_model": "qwen2.5:7b",
    "large_model": "qwen2.5:14b",
}

DISPOSITIONS = {
    "keep": [
        "Canadian_PR_Docs", "Employment_Records", "Certifications_Training", "Financial_Taxes",
        "Resumes_Career_Tech", "Medical_Health", "Travel_Transit", "AstroQuant_Sidereal",
        "Franchise_Business_Research", "Media_Images",
    ],
    "leave": ["Guidewire_PSE_Work", "Customer_Data", "Archives_and_Apps", "System_Junk"],
    "review": ["Credentials_Secrets", "Unknown_Unsorted"],
}
NEVER_EXPORT = ["Credentials_Secrets"]

# Scoring capacity per route: files one worker takes on, and most workers.
CAPACITY = [("ai-small", 25, 2), ("ai-large", 10, 1)]
