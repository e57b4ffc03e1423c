"""Words of questions in four languages, and the departments that they name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import let

# Words of a department's field, by its code.
DEPARTMENT_WORDS = {
    "AERO": "aerospace aeronautical flight space", "AEME": "aerospace mechanical turbomachinery propulsion aerodynamics",
    "BMEN": "biomedical engineering biology medical", "BMCS": "biomedical computational statistics genomics",
    "BMEB": "biomedical electrical neuroscience brain", "BMEE": "biomedical electrical neural control instrumentation",
    "BINF": "bioinformatics computational biomedical health", "APBM": "applied physics biomedical anatomy",
    "MEBM": "mechanical biomedical modeling morphogenesis", "EEBM": "electrical biomedical neuroscience neuroengineering",
    "CHEN": "chemical engineering chemistry", "CHEE": "chemical engineering thermodynamics colloid", "CBMF": "chemical biochemical molecular",
    "CHAP": "chemical applied physics statistical mechanics", "CIEN": "civil engineering structural construction",
    "CIEE": "civil environmental infrastructure risk", "CEEM": "civil engineering mechanics research",
    "CEOR": "civil engineering operations infrastructure optimization", "COMS": "computer science programming software algorithms",
    "CSOR": "operations research computer science optimization", "CSEE": "computer science electrical engineering embedded systems",
    "ORCS": "operations research computer science data decision", "EAEE": "earth environmental engineering sustainability climate",
    "EACE": "earth environmental civil hydrosystems pollution", "ECIA": "environmental civil infrastructure water management",
    "EESC": "earth environmental science climate dynamics", "EECS": "electrical engineering computer science",
    "ELEN": "electrical engineering circuits signals electronics", "ECBM": "electrical computer biomedical",
    "EEEL": "electrical engineering energy economics optimization", "EEME": "electrical engineering mechanical control systems",
    "IEOR": "industrial engineering operations research optimization", "EEOR": "electrical engineering operations research convex optimization",
    "DROM": "decision risk operations management analytics healthcare", "ORCA": "operations research data science foundations",
    "MECE": "mechanical engineering design manufacturing robotics", "MECS": "mechanical computer science evolutionary robotics",
    "MECH": "mechanical engineering combustion", "MEEM": "mechanical engineering materials small scale",
    "MEEE": "mechanical electrical acoustics signal", "MEIE": "mechanical engineering innovation space flight human",
    "IEME": "industrial engineering mechanical human centered design innovation", "MACH": "mechanical applied combustion",
    "MSAE": "materials science applied engineering crystallography", "APMA": "applied mathematics analysis numerical methods",
    "APPH": "applied physics quantum optics condensed matter", "APAM": "applied physics applied mathematics research",
    "APCH": "applied physics chemistry soft condensed matter", "ENGI": "engineering general introduction gateway art",
    "ENME": "engineering mechanics dynamics structures", "PLCE": "planning conservation environment urban",
    "PSAM": "quantitative methods social science", "GRAP": "graphics computer engineering visualization",
    "HSAM": "humanities science applied mathematics data history", "AHCE": "humanities civil engineering history roman",
    "MRKT": "marketing product management",
}
# Phrases that name a department.
DEPARTMENT_PHRASES = {
    "civil engineering": "CIEN", "civil eng": "CIEN", "electrical engineering": "ELEN", "electrical eng": "ELEN", "ee courses": "ELEN",
    "mechanical engineering": "MECE", "mechanical eng": "MECE", "mech eng": "MECE", "biomedical engineering": "BMEN", "biomed eng": "BMEN",
    "biomedical eng": "BMEN", "chemical engineering": "CHEN", "chem eng": "CHEN", "industrial engineering": "IEOR", "operations research": "IEOR",
    "applied mathematics": "APMA", "applied math": "APMA", "applied physics": "APPH", "computer science": "COMS", "comp sci": "COMS",
    "earth and environmental": "EAEE", "environmental engineering": "EAEE", "materials science": "MSAE", "nuclear engineering": "NUCL",
}
# Words that name a department beside those of its field.
DEPARTMENT_ALIASES = {
    "cs": "COMS", "compsci": "COMS", "computer": "COMS", "aerospace": "AERO", "aero": "AERO", "civil": "CIEN", "structural": "CIEN", "mechanical": "MECE",
    "mech": "MECE", "electrical": "ELEN", "ee": "ELEN", "ieor": "IEOR", "biomedical": "BMEN", "biomed": "BMEN", "physics": "APPH", "stats": "STAT",
    "statistics": "STAT", "materials": "MSAE", "environmental": "EAEE", "climate": "EAEE", "robotics": "MECE", "robot": "MECE", "data": "COMS",
}
# Words of a field that are too common to name a department.
COMMON_WORDS = ("engineering", "applied", "science", "math", "mathematics")

# Words that only name a department; other words of a field are topics. Codes of departments come with them.
NAMING_WORDS = (
    "cs compsci computer ieor aero aerospace civil mechanical mech electrical ee biomedical biomed environmental materials statistics stats physics chemical chem "
    "bioinformatics industrial"
)
# Words that count beside Chinese signs, too; so do codes.
ASCII_WORDS = "cs compsci ieor aero mech ee biomed stats chem"

# English for Chinese, Spanish and French words of questions.
CHINESE = {
    "航空": "aerospace", "航天": "aerospace", "土木": "civil engineering", "计算机": "computer science", "机械": "mechanical engineering",
    "电子": "electrical engineering", "电气": "electrical engineering", "数学": "mathematics", "物理": "physics", "统计": "statistics",
    "化学": "chemical engineering", "化工": "chemical engineering", "材料": "materials science", "生物医学": "biomedical", "环境": "environmental engineering",
    "工业工程": "industrial engineering", "运筹": "operations research", "周一": "Monday", "周二": "Tuesday", "周三": "Wednesday", "周四": "Thursday", "周五": "Friday",
    "周六": "Saturday", "周日": "Sunday", "星期一": "Monday", "星期二": "Tuesday", "星期三": "Wednesday", "星期四": "Thursday", "星期五": "Friday", "上午": "morning",
    "下午": "afternoon", "晚上": "evening", "早上": "morning", "推荐": "recommend", "比较": "compare", "对比": "compare", "建议": "recommend suggest",
    "推荐一下": "recommend", "给我": "give me", "帮我找": "help me find", "有什么": "what are", "有哪些": "what are", "有什么好的": "good courses", "有哪些好的": "good courses",
    "介绍": "recommend", "推荐课程": "recommend courses", "课程建议": "course recommendations", "课程": "courses", "好的": "good", "什么时候": "when schedule",
    "学分": "credits", "先修课": "prerequisites", "教授": "professor", "想学": "want to study", "想上": "want to take", "想了解": "interested", "感兴趣": "interested",
    "机器人": "robotics robot", "人工智能": "artificial intelligence ai", "机器学习": "machine learning", "数据科学": "data science", "结构": "structural",
    "设计": "design", "编程": "programming", "算法": "algorithms", "力学": "mechanics", "热力学": "thermodynamics", "信号处理": "signal processing",
    "控制": "control systems", "量子": "quantum", "量子计算": "quantum computing", "深度学习": "deep learning", "神经网络": "neural networks",
    "计算机视觉": "computer vision", "自然语言": "natural language", "数据库": "database", "操作系统": "operating systems", "网络": "networks", "安全": "security",
    "密码": "cryptography", "优化": "optimization", "概率": "probability", "线性代数": "linear algebra", "微积分": "calculus", "流体": "fluid mechanics",
    "有限元": "finite element", "复合材料": "composite materials", "纳米": "nanotechnology", "能源": "energy", "可持续": "sustainability", "气候": "climate",
    "金融工程": "financial engineering", "供应链": "supply chain", "生物": "biology bioengineering", "医学影像": "medical imaging", "嵌入式": "embedded systems",
    "电路": "circuits", "航空航天": "aerospace", "推进": "propulsion", "空气动力": "aerodynamics", "高级": "advanced", "毕业设计": "capstone design", "实习": "internship",
}
SPANISH = {
    "ingeniería civil": "civil engineering", "ingeniería mecánica": "mechanical engineering", "ciencias de la computación": "computer science",
    "aeroespacial": "aerospace", "lunes": "Monday", "martes": "Tuesday", "miércoles": "Wednesday", "jueves": "Thursday", "viernes": "Friday",
    "mañana": "morning", "tarde": "afternoon", "noche": "evening", "recomendar": "recommend", "comparar": "compare", "recomiéndame": "recommend",
    "recomendame": "recommend", "sugiéreme": "suggest", "sugiereme": "suggest", "dame": "give me", "ayúdame a encontrar": "help me find",
    "qué cursos": "what courses", "cuáles cursos": "what courses", "cursos buenos": "good courses", "sugerencias": "suggestions",
    "recomendaciones": "recommendations", "computación": "computer science", "matemáticas": "mathematics", "buenos cursos": "good courses",
    "mejores cursos": "best courses", "créditos": "credits", "profesor": "professor", "robótica": "robotics robot", "robotica": "robotics robot",
    "aprendizaje automático": "machine learning", "aprendizaje automatico": "machine learning", "aprendizaje profundo": "deep learning",
    "inteligencia artificial": "artificial intelligence ai", "ciencia de datos": "data science", "estructural": "structural",
    "estructuras": "structural", "termodinámica": "thermodynamics", "termodinamica": "thermodynamics", "mecánica": "mechanics", "mecanica": "mechanics",
    "algoritmos": "algorithms", "programación": "programming", "programacion": "programming", "diseño": "design", "diseno": "design",
    "señales": "signal processing", "senales": "signal processing", "control": "control systems", "energía": "energy", "energia": "energy",
    "medio ambiente": "environmental engineering", "biomédica": "biomedical", "biomedica": "biomedical", "materiales": "materials science",
    "química": "chemical engineering", "quimica": "chemical engineering", "por la mañana": "morning", "por la tarde": "afternoon",
}
FRENCH = {
    "recommande": "recommend", "recommandez": "recommend", "recommande-moi": "recommend me", "recommandez-moi": "recommend me", "suggère": "suggest",
    "suggerez": "suggest", "suggère-moi": "suggest me", "suggerez-moi": "suggest me", "donne-moi": "give me", "donnez-moi": "give me",
    "aide-moi à trouver": "help me find", "quels cours": "what courses", "quelles cours": "what courses", "informatique": "computer science",
    "suggestions": "suggestions", "recommandations": "recommendations", "bons cours": "good courses", "meilleurs cours": "best courses",
    "génie civil": "civil engineering", "genie civil": "civil engineering", "génie mécanique": "mechanical engineering",
    "genie mecanique": "mechanical engineering", "génie électrique": "electrical engineering", "genie electrique": "electrical engineering",
    "génie chimique": "chemical engineering", "genie chimique": "chemical engineering", "aérospatiale": "aerospace", "aerospatiale": "aerospace",
    "mathématiques": "mathematics", "mathematiques": "mathematics", "physique": "physics", "statistique": "statistics", "biomédical": "biomedical",
    "biomedical": "biomedical", "matériaux": "materials science", "materiaux": "materials science", "environnement": "environmental engineering",
    "robotique": "robotics robot", "apprentissage automatique": "machine learning", "apprentissage profond": "deep learning",
    "intelligence artificielle": "artificial intelligence ai", "science des données": "data science", "science des donnees": "data science",
    "algorithmes": "algorithms", "programmation": "programming", "structures": "structural", "structurel": "structural",
    "thermodynamique": "thermodynamics", "mécanique": "mechanics", "conception": "design", "traitement du signal": "signal processing",
    "énergie": "energy", "energie": "energy", "lundi": "Monday", "mardi": "Tuesday", "mercredi": "Wednesday", "jeudi": "Thursday", "vendredi": "Friday",
    "matin": "morning", "après-midi": "afternoon", "apres-midi": "afternoon", "soir": "evening", "crédits": "credits", "professeur": "professor",
}


def department_words() -> dict[str, str]:
    """Department of a word that names one: the first whose field has it, its own code, then the aliases."""
    out: dict[str, str] = {}
    for code, field in DEPARTMENT_WORDS.items():
        for word in [*field.split(), code.lower()]:
            out.setdefault(word, code)
    naming = {*NAMING_WORDS.split(), *(code.lower() for code in DEPARTMENT_WORDS)}
    return {word: code for word, code in (out | DEPARTMENT_ALIASES).items() if word in naming and word not in COMMON_WORDS}


def with_english(question: Column, tables: tuple[Mapping[str, str], ...] = (CHINESE, SPANISH, FRENCH)) -> Column:
    """A question followed by the English of the foreign words that it has, in the tables' order; null for null."""
    merged: dict[str, str] = {}
    for table in tables:
        merged.update(table)
    pairs = F.array(*(F.struct(F.lit(word.lower()).alias("word"), F.lit(english).alias("english")) for word, english in merged.items()))
    # Lower case once, not for every word of the tables.
    found = let(F.lower(question), lambda low: F.transform(F.filter(pairs, lambda p: low.contains(p["word"])), lambda p: p["english"]))
    return let(found, lambda f: F.when(question.isNotNull(), F.concat_ws(" ", question, F.array_join(F.when(F.size(f) > 0, f), " "))))


def department_named(question: Column, phrases: Mapping[str, str] = DEPARTMENT_PHRASES, words: Mapping[str, str] | None = None) -> Column:
    """Department that a question names: by its longest known phrase, else by its longest known word; null if none."""
    words = department_words() if words is None else words
    longest = lambda table: F.array(*(F.struct(F.lit(w).alias("word"), F.lit(table[w]).alias("code")) for w in sorted(table, key=lambda w: -len(w))))
    # Short names and codes count beside Chinese signs, other words only by themselves.
    ascii_words = {*ASCII_WORDS.split(), *(code.lower() for code in DEPARTMENT_WORDS)}

    def named(low: Column) -> Column:
        phrase = F.get(F.filter(longest(phrases), lambda p: low.contains(p["word"])), F.lit(0))
        runs, whole = (F.regexp_extract_all(low, F.lit(kind), F.lit(1)) for kind in (r"([a-z0-9_]+)", r"([\p{L}\p{N}_]+)"))
        held = F.array_union(F.filter(runs, lambda w: w.isin(*sorted(ascii_words))), whole)
        # The question's words are read once, not for every word of the table.
        word = let(held, lambda h: F.get(F.filter(longest(words), lambda p: F.array_contains(h, p["word"])), F.lit(0)))
        return F.coalesce(phrase["code"], word["code"])

    return let(F.lower(question), named)


def localised(texts: Mapping[str, Mapping[str, str]], name: Column, language: Column) -> Column:
    """Text ``name`` in a language; in English where that has none."""
    table = F.create_map(*(F.lit(x) for lang, named in texts.items() for key, text in named.items() for x in (f"{lang}:{key}", text)))
    look = lambda lang: F.try_element_at(table, F.concat(lang, F.lit(":"), name))
    return F.coalesce(look(F.coalesce(language, F.lit("en"))), look(F.lit("en")))
