"""Fixed values of the vocabulary: what a typed keyword of each slot is called in the vocabulary."""

#: The slots of the vocabulary.
SLOTS = ["garments_tags", "colors_tags", "material_tags", "patterns_tags", "silhouette_tags", "length_tags", "neckline_tags", "sleeve_tags", "closure_tags", "embellishment_tags", "style_tags"]

#: Terms without meaning.
STOP_TERMS = ["", "n/a", "na", "none", "null", "unknown", "other"]

#: Colours of several words and of one word, in English.
COLOR_PHRASES = {"blu scuro": "dark blue", "bleu scuro": "dark blue", "grigio scuro": "dark gray", "rosso vino": "wine red", "rosso bordeaux": "burgundy"}
COLOR_WORDS = {
    "nero": "black", "nera": "black", "neri": "black", "nere": "black", "bianco": "white", "bianca": "white", "bianchi": "white", "bianche": "white",
    "blu": "blue", "bleu": "blue", "azzurro": "blue", "azzurra": "blue", "rosso": "red", "rossa": "red", "rossi": "red", "rosse": "red",
    "verde": "green", "verdi": "green", "giallo": "yellow", "gialla": "yellow", "marrone": "brown", "marroni": "brown",
    "grigio": "gray", "grigia": "gray", "grigi": "gray", "grigie": "gray", "grey": "gray", "oro": "gold", "dorato": "gold", "dorata": "gold",
    "argento": "silver", "avorio": "ivory", "rosa": "pink", "viola": "purple", "fucsia": "fuchsia", "bordeaux": "burgundy", "ocra": "ochre", "crema": "cream", "paglia": "straw",
}
#: English colours, which stand for themselves when texts are searched for colours.
COLORS_THEMSELVES = ["black", "white", "blue", "red", "green", "yellow", "brown", "gray", "gold", "silver", "ivory", "pink", "purple", "beige", "fuchsia"]
COLOR_REJECTS = ["burnt", "bruciato"]

#: Words replaced within a material's or pattern's name, in this order.
MATERIAL_WORDS = {"gazaar": "gazar", "grosgrain": "gros grain", "raso": "satin", "velluto": "velvet", "seta": "silk", "lana": "wool", "cotone": "cotton", "pizzo": "lace", "cachemire": "cashmere", "rafia": "raffia", "paillettes": "sequins", "piqué": "pique"}
PATTERN_WORDS = {"stripes": "stripe", "striping": "stripe", "righe": "stripe", "bird s eye": "birdseye", "bird eye": "birdseye"}

#: Fabrics that are named after their fibre, "<fabric> di silk", and are called "silk <fabric>".
OF_SILK = ["faille", "georgette", "organza", "chiffon", "gazar", "cady", "taffeta", "velvet", "serge", "crepe de chine", "mousseline", "jacquard", "marocain", "duchesse", "jersey", "tulle", "satin", "cannete", "natte"]

#: Whole names by slot.
NAMES = {
    "garments_tags": {
        "abito": "dress", "abito da sera": "evening dress", "ball gown": "ballgown", "cabane": "caban", "camicia": "shirt", "canotta": "tank top", "cappotto": "coat", "completo": "ensemble",
        "completo due pezzi": "two piece outfit", "giacca": "jacket", "giacchino": "jacket", "gonna": "skirt", "lana coat": "wool coat", "pantaloni": "pants", "scialle": "shawl", "soprabito": "overcoat", "stola": "stole",
    },
    "colors_tags": {"bluette": "bright blue", "bois de rose": "rosewood", "carne": "nude", "cipria": "powder pink"},
    "material_tags": {
        **{f"{x} di silk": f"silk {x}" for x in OF_SILK}, "organza silk": "silk organza", "jersey di wool": "wool jersey", "nastro di silk": "silk tape", "cotton piquet": "cotton pique", "piquet di cotton": "cotton pique",
        "wool silk satin": "wool/silk satin", "satin di wool silk": "wool/silk satin", "wool silk blend": "wool/silk blend", "wool silk": "wool/silk blend", "wool silk blend fabric": "wool/silk blend",
        "crinolina di nylon": "nylon crinoline", "jacquard wool": "wool jacquard", "legno": "wood", "lurex oro": "gold lurex", "pelliccia di volpe": "fox fur", "tulle elasticizzato": "elasticized tulle",
        "canottiglia": "bugle beads", "canottiglie": "bugle beads", "filo di viscosa": "viscose yarn", "jais": "jet", "lace macrame di cotton": "cotton macrame lace", "paglia di vienna": "vienna straw",
        "panno di wool": "wool cloth", "tobolari di organza": "organza tubing", "zibellino": "sable", "piqu": "pique",
    },
    "patterns_tags": {"disegno a volute": "scroll pattern", "disegno cachemire": "paisley pattern", "disegno floreale": "floral pattern", "floreale": "floral", "ricamo": "embroidered", "stampa paisley": "paisley print", "volute barocche": "baroque volutes"},
    "silhouette_tags": {
        "aderente": "body hugging", "ampia": "ample", "ampio": "ample", "arricciate": "gathered", "corta": "short", "effetto drappeggio": "draped effect", "fasciante": "body hugging", "linea ampia": "ample line",
        "linea arrotondata": "rounded line", "linea asciutta": "slim line", "linea diritta": "straight line", "linea dritta": "straight line", "linea morbida": "soft line", "svasata": "flared",
        "taglio maschile": "masculine cut", "vestibilita asciutta": "slim fit", "vita alta": "high waist", "voluminose": "voluminous",
    },
    "length_tags": {
        "3 4": "three quarter length", "al ginocchio": "knee length", "alla caviglia": "ankle length", "corta": "short", "lunga alla caviglia": "ankle length", "lunga a terra": "floor length", "lunghe": "long",
        "lunghezza ai fianchi": "hip length", "lunghezza al ginocchio": "knee length", "primo fianco": "high hip", "sopra il ginocchio": "above the knee",
    },
    "neckline_tags": {
        "ampio arrotondato a scialle": "wide rounded shawl lapel", "arrotondato a scialle": "shawl lapel", "crewneck": "crew neck", "girocollo": "crew neck", "revers": "lapel", "revers a lancia": "peak lapel",
        "revers a uomo": "menswear lapel", "scollo a barca": "boat neck", "scollo a v": "v neckline", "scollo all americana": "halter neck", "v neck": "v neckline",
    },
    "sleeve_tags": {
        "3 4 sleeves": "three quarter sleeves", "manica lunga a tubo": "long tubular sleeves", "maniche arricciate": "gathered sleeves", "maniche a kimono": "kimono sleeves", "maniche corte": "short sleeves",
        "maniche lunghe": "long sleeves", "maniche voluminose": "voluminous sleeves", "no sleeves": "sleeveless", "senza maniche": "sleeveless", "spalle importanti": "pronounced shoulders",
    },
    "closure_tags": {
        "allacciatura a un bottone": "one button closure", "automatic button": "snap button", "automatico": "snap button", "asola": "buttonhole", "automatici": "snap buttons", "bottone": "button",
        "bottoni automatici ricoperti": "covered snap buttons", "bottoni rivestiti": "covered buttons", "chiusura con due bottoni rivestiti": "two covered button closure", "chiusura con zip sul dorso": "back zip closure",
        "chiusura lampo": "zip closure", "chiusura posteriore": "back closure", "gancio": "hook", "gancio in metallo": "metal hook closure", "lateral zip": "side zip closure", "monopetto": "single breasted",
        "senza chiusure": "no closure", "zip laterale": "side zip closure", "zipper": "zip closure",
    },
    "embellishment_tags": {
        "applicazione": "applique", "applicazioni": "appliques", "applicazioni all over di fiori ricamati": "all over embroidered floral appliques", "balza": "flounce", "balza di tulle plissettato": "pleated tulle flounce",
        "canottiglia": "bugle beads", "canottiglie": "bugle beads", "ciuffi": "tassels", "drappeggio": "draping", "fiori": "flowers", "fiori ricamati": "embroidered flowers", "fiocchi": "bows", "fori": "cutouts",
        "imbottito": "padded", "impunturati": "topstitched", "impunturato": "topstitched", "impunture": "topstitching", "impunture orizzontali": "horizontal topstitching", "jais": "jet", "motivi floreali": "floral motifs",
        "motivo a pieghe": "pleated motif", "nastri": "ribbons", "orlo festonato": "scalloped hem", "orlo irregolare a smerli": "irregular scalloped hem", "paillette": "sequin", "paillettes": "sequins", "perline": "beads",
        "pieghe": "pleats", "plissettatura": "pleating", "punto catenella": "chain stitch", "ramoscelli": "sprigs", "ricoperto": "covered", "ricamato": "embroidered", "ricamo": "embroidery", "ricamo a mano": "hand embroidery",
        "righe": "stripes", "tasche rettangolari applicate": "rectangular patch pockets", "tassles": "tassels", "traforature": "openwork", "trapuntatura": "quilted", "volute": "scrollwork", "volute barocche": "baroque volutes",
    },
    "style_tags": {"alta moda": "couture", "taglio maschile": "mannish"},
}

#: Which fields of a bundle are searched for a slot's terms; None are all fields.
HARVEST_FIELDS = {"colors_tags": None, "patterns_tags": None, "material_tags": ["materials", "description", "working_process"], "garments_tags": ["object", "description", "label"]}

#: Seed terms that aren't any, styles that are never and always wanted, parts that are no garments.
SEED_REJECTS = ["no dress", "no neckline", "no opening", "no special manufacturing technique", "no non textile material", "no waistline", "no fastening", "no closure", "conventional", "regular fit", "normal waist", "regular collar"]
STYLES_ALLOWED = ["boho chic", "bohemian style", "business casual", "casual", "clubwear", "couture", "daywear", "dress clothes", "empire silhouette", "eveningwear", "formal", "gothic fashion", "ivy league", "military", "preppy", "utility", "wilderness chic"]
STYLES_BANNED = ["anti fashion", "bogan", "chav", "cycle chic", "flogger", "heroin chic", "nazi chic", "pokemon subculture", "pokémon subculture", "size zero", "sloane ranger", "style tribe", "swenkas", "thrift store chic", "young fogey"]
PARTS = ["collar", "lapel", "neckline", "pocket", "sleeve", "hood"]
#: Colours that are kept without being archived.
CORE_COLORS = ["beige", "black", "blue", "bronze", "brown", "camel", "champagne", "charcoal", "coral", "cream", "ecru", "gold", "gray", "green", "grey", "indigo", "ivory", "khaki", "lavender", "lilac", "magenta", "maroon", "mauve", "navy", "ochre", "olive", "orange", "pink", "purple", "red", "rose", "rust", "saffron", "silver", "taupe", "teal", "turquoise", "violet", "white", "wine", "yellow"]
#: Remarks in parentheses that belong to a seed term.
CONTEXTS = ["pattern", "length", "neck", "neckline", "collar", "lapel", "sleeve", "skirt", "dress", "coat", "jacket", "pants", "shorts", "opening"]

#: Scores of seed files by name, and parts of paths that rule a file out or add to its score.
SEED_FILES = {"category_attributes_descriptions.json": 200, "list_category_cloth.txt": 190, "list_attr_cloth.txt": 190, "clothingtypes.json": 170, "clothingmaterials.json": 170, "clothingstyles.json": 155, "colors.json": 150, "clothing-materials.json": 150}
SEED_BLACKLIST = ["/eval/", "/anno_fine/train", "/anno_fine/test", "/anno_fine/val", "/weatherconditions", "/events", "/religions", "/seasons", "/date.xml", "/clothingsizes", "/readme", "/requirements.txt", "/license.txt", "/sample.json", "/list_eval_partition.txt", "/list_bbox.txt", "/list_landmarks.txt", "/list_joints.txt"]
SEED_SUFFIXES = ["json", "jsonl", "txt", "owl", "xml", "rdf"]
#: The slot of a typed list's attribute by its number.
ATTRIBUTE_SLOTS = {"1": "patterns_tags", "2": "sleeve_tags", "3": "length_tags", "4": "neckline_tags", "5": "material_tags", "6": "silhouette_tags"}
#: How many external terms a slot keeps.
LIMITS = {"garments_tags": 40, "colors_tags": 24, "material_tags": 32, "patterns_tags": 24, "silhouette_tags": 24, "length_tags": 18, "neckline_tags": 24, "sleeve_tags": 18, "closure_tags": 18, "embellishment_tags": 24, "style_tags": 16}
