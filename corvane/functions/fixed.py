"""Words and patterns that results must agree on, by profile. Blanks in phrases stand for any white space."""

from __future__ import annotations

# Labels at the start of a line that names a person, taxonomy profile.
TAXONOMY_LABELS = """
full name|candidate name|name|nama lengkap|nama|email|e-mail|phone|mobile|telepon|date of birth|dob|birthday|tanggal lahir|tgl lahir
address|home address|alamat|alamat rumah
"""
TAXONOMY_NUMBERED = r"no(?:mor)?\s*(?:hp|telepon|telp)"
TAXONOMY_BIRTH = r"\b(?:dob|date of birth|birthday|tanggal lahir|tgl lahir)\s*[:|-]?\s*[^,;|]+"

# The same of the live profile.
LIVE_LABELS = """
full name|candidate name|nama|nama lengkap|nama kandidat|name|email|e-mail|surel|phone|mobile|ponsel|telepon|hp
nik|ktp|paspor|passport|national id|id number|identity number|identity card|social security|social security number|ssn|photo|foto|pasfoto
date of birth|tempat lahir|tanggal lahir|ttl|dob|birthday
address|home address|alamat|alamat rumah|alamat domisili|alamat lengkap|age|usia|umur|gender|sex|jenis kelamin|religion|agama
marital status|status perkawinan|status pernikahan|status menikah|race|ethnicity|suku|etnis|disability|disabilitas|nationality|kewarganegaraan
"""
LIVE_NUMBERED = r"no\.?\s*(?:hp|telepon|ktp|nik|identitas)|nomor(?:\s+(?:hp|telepon|ktp|nik|identitas|induk\s+kependudukan))?|tempat(?:\s*[,/]\s*|\s+)tanggal\s+lahir|tgl\.?\s*lahir"
LIVE_BIRTH = r"\b(?:dob|date of birth|birthday|(?:tempat\s*[,/]\s*)?tanggal\s+lahir|tempat\s+lahir|tgl\.?\s*lahir|ttl)\s*[:|-]?\s*[^;|]+"
AGE = r"\b(?:age|usia|umur)\s*[:=|–-]?\s*\d{1,3}\b|\b(?:aged?|berusia)\s+\d{1,3}(?:\s+tahun)?\b|\b\d{1,3}\s*(?:years?\s+old|years?\s+of\s+age)\b"

# Headings at which a section begins.
HEADINGS = """
skills|technical skills|keahlian|kemampuan|experience|professional experience|work experience|pengalaman|pengalaman kerja|riwayat pekerjaan
employment|education|pendidikan|project|projects|proyek|certificate|certificates|certification|certifications|sertifikat|sertifikasi
languages|bahasa|summary|ringkasan|profile|profil|objective|tujuan
"""

# Cues that deny what follows, and what after them does not.
CUES = r"no|not|never|without|lack(?:s|ed|ing)?|avoid(?:s|ed|ing)?|don't|doesn't|didn't|tidak|belum|tanpa|kurang|bukan|jarang"
NOT_DENIED = {("not", "bukan"): ("only", "just", "hanya", "sekadar", "cuma"), ("kurang",): ("lebih", "dari")}

# Number words, and the phrases around a duration.
NUMBERS_EN = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
NUMBERS_ID = "satu|dua|tiga|empat|lima|enam|tujuh|delapan|sembilan|sepuluh|sebelas|dua belas|tiga belas|empat belas|lima belas|enam belas|tujuh belas|delapan belas|sembilan belas|dua puluh"
ABOUT = "more than|over|nearly|close to|roughly|about|around|kurang lebih|lebih dari|sekitar|hampir|selama"
VAGUE = "a few|few|several"
AGE_BEFORE = r"\b(?:aged|age|usia|umur|berusia|berumur)\s*(?:(?:is|of|saya)\s*)?[:=]?\s*$"

# Wording of credentials.
CREDENTIALS = (
    r"doctor(?:ate|al)?(?:\s+of\s+(?:philosophy|medicine|education))?", r"ph\.?\s*d\.?", "dphil",
    r"master(?:['’]s(?:\s+degree)?|\s+degree|\s+(?:of|in)\s+(?:arts|science|engineering|education|business\s+administration))",
    r"m\.?\s*s\.?", r"m\.?\s*sc\.?", r"m\.?\s*a\.?", r"m\.?\s*eng\.?", "mba",
    r"bachelor(?:'s)?(?:\s+(?:degree|of\s+(?:arts|science|engineering|education|business\s+administration)))?",
    r"b\.?\s*s\.?", r"b\.?\s*sc\.?", r"b\.?\s*a\.?", r"b\.?\s*eng\.?", "bsc",
    r"associate\s+diploma", r"associate(?:['’]s(?:\s+degree)?|\s+degree|\s+of\s+(?:arts|science|engineering))",
    r"(?:(?:professional|foundation|associate|secondary\s+vocational|higher)\s+)?diploma(?:\s+of\s+higher\s+education)?",
    r"(?:(?:foundation|higher\s+secondary|vocational)\s+)?foundation\s+certificate", r"higher\s+secondary\s+certificate", r"vocational\s+certificate",
    r"certificate\s+of\s+completion", r"sarjana(?:\s+terapan)?", "magister", "doktor", "s[1-3]", "d[1-4]",
)

# Skills of the live profile, and other words for them.
LIVE_SKILLS = tuple(
    "python|java|javascript|typescript|c++|c#|go|golang|rust|sql|postgresql|mysql|mongodb|redis|fastapi|django|flask|react|react.js|node.js|node|next.js|vue|angular"
    "|html|css|aws|azure|gcp|docker|kubernetes|terraform|linux|git|machine learning|deep learning|pytorch|tensorflow|scikit-learn|nlp|llm|rag|data analysis|pandas|spark"
    "|airflow|tableau|power bi|project management|agile|scrum|stakeholder management|cross-functional collaboration|communication".split("|")
)
LIVE_ALIASES = {
    "python": ("python", "python3"),
    "javascript": ("javascript", "js", "ecmascript"),
    "typescript": ("typescript", "ts"),
    "postgresql": ("postgresql", "postgres", "postgres db"),
    "fastapi": ("fastapi", "fast api"),
    "react": ("react", "react.js", "reactjs"),
    "node.js": ("node.js", "nodejs", "node"),
    "machine learning": ("machine learning", "ml"),
    "deep learning": ("deep learning", "dl"),
    "cross-functional collaboration": ("cross-functional collaboration", "cross functional collaboration", "worked across teams", "cross-functional team"),
}

# English words left out of retrieval.
STOP_EN = """
a about above after again against all am an and any are aren't as at be because been before being below between both but by can can't cannot could
couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's her
here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor
not of off on once only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's
the their theirs them themselves then there there's these they they'd they'll they're they've this those through to too under until up very was wasn't we
we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's with won't would wouldn't you you'd you'll
you're you've your yours yourself yourselves
"""
# Common Indonesian words left out of retrieval; longer lists come as a parameter of ``tokenize``.
STOP_ID = """
ada adalah agar akan aku anda antara apa apabila apakah atas atau bagaimana bagi bahwa banyak beberapa belum bila bisa boleh bukan cuma dalam dan dapat
dari daripada demi dengan di dia hal hampir hanya harus hingga ia ini itu jadi jangan jika juga kalau kami kamu kan kapan karena ke kepada kita kurang lagi
lain lalu lebih maka mana masih maupun melalui menjadi mereka merupakan namun oleh pada para pernah saat saja sama sampai sangat satu saya sebagai sebelum
sebuah sedang sejak selain selama seluruh semua seperti serta setelah setiap siapa suatu sudah supaya tanpa tapi telah tentang terhadap tetapi tiap tidak
untuk yaitu yakni yang
"""
SIGNALS = """
wajib preferensi kriteria rubrik wawancara panduan skor nilai syarat tugas posisi lowongan kompetensi bukti interview rubric criteria required preferred
requirement qualification job role score evidence star behavioral c r go it
"""
