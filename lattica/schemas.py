"""Fixed values of the data model: schemas (as DDL), vocabularies and thresholds."""

from __future__ import annotations

FILES = "canonical_path STRING, source STRING"
BLUEPRINT = "schema_version STRING, metadata STRUCT<total_nodes_indexed:LONG,total_edges:LONG,total_clusters:LONG,max_cluster_size:LONG,domains:ARRAY<STRING>>, nodes ARRAY<STRUCT<id:STRING,canonical_path:STRING,cluster_id:STRING,execution_role:STRING,centrality_score:DOUBLE,is_god_file:BOOLEAN,domain:STRING>>, edges ARRAY<STRUCT<source:STRING,target:STRING,type:STRING,weight:DOUBLE,is_dead_import:BOOLEAN,is_synthetic:BOOLEAN>>, clusters ARRAY<STRUCT<id:STRING,name:STRING,parent_cluster_id:STRING,suggested_title:STRING,domain:STRING>>, entry_points ARRAY<STRUCT<file:STRING,url:STRING,kind:STRING>>"

# Edge types.
NON_STRUCTURAL = ("RENDERS", "SEMANTIC_SIMILARITY", "CALLS_API", "EMITS_EVENT", "PROVIDES_STATE")
CONTRACT_TYPES = ("CALLS_API", "EMITS_EVENT", "PROVIDES_STATE")
IMPORT_TYPES = ("BELONGS_TO_DOMAIN", "RENDERS")

# Thresholds.
MAX_CLUSTER_SIZE, MIN_CLUSTER_SIZE = 30, 3
SPLIT_RESOLUTION = 1.5
SHARED_IN_RATIO, ORCHESTRATOR_OUT_RATIO = 0.10, 0.15
TEST_BOOST, CONVENTION_WEIGHT, SEMANTIC_WEIGHT = 50.0, 0.4, 0.2
LAYER_WORD_SHARE, NAME_MAX_SHARE = 0.35, 0.60
EMERGENT_MIN_FILES, EMERGENT_MAX_SHARE, EMERGENT_LIMIT = 3, 0.50, 12
POLLS, POLL_SECONDS, POLL_ERRORS = 900, 2, 5  # fixed values: how often a task is asked, how long between, failures in a row
DECAY, ROUNDS, TOLERANCE, DEAD_FACTOR = 0.85, 30, 1e-4, 0.3
NODE_MIN_SCORE, MARGIN, CLUSTER_MIN_SHARE = 0.15, 1.5, 0.40
MAX_STATE_PAIRS, MAX_ENTRY_POINTS, UNREACHED_SAMPLE = 150, 40, 50

# Directories that a crawl leaves out, and the suffixes that it takes.
SKIPPED_DIRS = ("node_modules", ".next", "dist", "build", ".git", ".turbo", "coverage", ".venv", "__pycache__", ".cache")
# Directories that an uploaded archive leaves out.
SKIPPED_IN_ZIP = ("node_modules", ".git", ".next", "dist", "build", ".turbo", "coverage", ".cache", "out", ".svn", "__pycache__", ".idea", ".vscode", "vendor", "target", "bin", "obj")
CONFIGURATIONS = ("tsconfig.json", "tsconfig.base.json", "jsconfig.json", "package.json", "pnpm-workspace.yaml")
SUFFIXES = (".js", ".jsx", ".ts", ".tsx", ".mjs")
PROBES = ("", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", "/index.js", "/index.ts", "/index.jsx", "/index.tsx")

# Administrative files.
ADMIN_SEGMENT = r"(?i)(^|/)(scripts?|migrations?|migrate|seeders?|seeds?|fixtures?|deploy|deployment|devops|infra|infrastructure|database|db|setup|bootstrap|bin)(/|$)"
ADMIN_NAME = r"(?i)(\.config\.(js|ts|mjs|cjs)$|\.setup\.(js|ts)$|ecosystem\.config\.|jest\.config\.|webpack\.config\.|babel\.config\.|rollup\.config\.|vite\.config\.|next\.config\.|tailwind\.config\.|postcss\.config\.|prettier\.config\.|eslint\.config\.|knexfile\.|\.seed\.(js|ts)$|create-.*\.(js|ts)$|reset-.*\.(js|ts)$|migrate-.*\.(js|ts)$|quick-fix.*\.(js|ts)$|instrument\.(js|ts)$|test-sentry\.(js|ts)$)"
TEST_FILE = r"(?i)(^|/)(tests?|__tests__|spec)(/|$)|\.(test|spec)\.(js|ts|jsx|tsx|mjs)$"

# Conventions of file names.
TIERS = {0: "route routes router routers", 1: "controller controllers handler handlers", 2: "service services", 3: "repository repositories repo repos dao", 4: "model models schema schemas entity entities"}
CONVENTION_STEMS = ("page", "layout", "loading", "error", "not-found", "default", "template", "route", "global-error", "global-not-found")
ENTRY_STEMS = (*CONVENTION_STEMS, "middleware")
ROUTING_LAYOUTS, JOURNEY_LAYOUTS = ("layout", "global-error"), ("layout", "template")
SERVER_STEMS = ("server", "app", "index", "main")
SHARED_UI = ("packages/ui/", "components/ui/", "ui/components/", "src/components/ui/", "lib/components/")
GUARD = r"(?i)(protected|auth[-_]?guard|guard[-_]?auth|require[-_]?auth|with[-_]?auth|private[-_]?route|authenticated|auth[-_]?check)"
LOGIN = r"(?i)(^|/)(login|signin|sign-in|log-in)(/|$)"

# Runtime contracts.
HTTP_VERBS = ("get", "post", "put", "patch", "delete", "head", "options", "all")
ROUTER_OBJECTS = ("app", "router", "server", "api", "route", "routes")
CLIENT_OBJECTS = ("axios", "http", "https", "client", "apiClient", "api", "request", "fetcher", "instance", "httpClient", "$http")
CLIENT_FUNCTIONS = ("fetch", "axios", "request", "useSWR", "useQuery")
SERVER_PACKAGES = ("express", "fastify", "koa", "@koa/router", "hapi", "@hapi/hapi", "restify")
EMITS = ("emit", "dispatchEvent", "publish", "send", "trigger")
LISTENS = ("on", "once", "addEventListener", "subscribe", "addListener")
DOM_EVENTS = "click change submit input focus blur keydown keyup keypress mousedown mouseup mouseover mouseout mousemove scroll resize load unload error close open message drag dragend dragover drop touchstart touchend wheel data end finish connect disconnect abort complete".split()

# Words that carry no meaning in paths.
LAYER_WORDS = "src app lib index main init controller controllers service services route routes router routers model models schema schemas middleware middlewares handler handlers util utils helper helpers common shared config configs settings constants types enums test tests spec specs unit integration email templates template sender transporter js ts jsx tsx mjs cjs old new base core api data".split()
STOPWORDS = """src app apps lib libs index main init controller controllers service services route routes router routers
model models schema schemas middleware middlewares handler handlers util utils helper helpers common shared config configs settings
constants types enums test tests spec specs unit component components page pages view views hook hooks layout layouts style styles
asset assets public core base api data feature features module modules package packages domain domains template templates validator
validators swagger annotation annotations old new js ts jsx tsx mjs cjs dialog dialogs modal modals menu menus sidebar sidebars toolbar
toolbars panel panels tab tabs tooltip tooltips dropdown dropdowns popup popups popover popovers button buttons radio picker pickers
icon icons card cards badge badges spinner spinners loader loaders banner banners context contexts event events action actions client
clients provider providers reducer reducers store stores state states callback callbacks listener listeners docs doc example examples
demo demos welcome playground sandbox""".split()

# Business domains by package, by package prefix and by path word.
PACKAGES = {
    "AUTHENTICATION": "bcrypt bcryptjs argon2 jsonwebtoken jose passport next-auth express-session cookie-session express-jwt otplib speakeasy lucia",
    "PAYMENTS": "stripe braintree razorpay square paypal-rest-sdk sslcommerz-lts",
    "EMAIL_NOTIFICATION": "nodemailer postmark resend mailgun-js mailgun.js twilio",
    "FILE_STORAGE": "multer cloudinary formidable busboy minio @aws-sdk/client-s3",
    "SEARCH": "algoliasearch meilisearch fuse.js",
    "ADMIN": "adminjs react-admin",
    "API_INTEGRATION": "googleapis",
}
PACKAGE_PREFIXES = (("passport-", "AUTHENTICATION"), ("@auth/", "AUTHENTICATION"), ("@clerk/", "AUTHENTICATION"), ("@stripe/", "PAYMENTS"), ("@paypal/", "PAYMENTS"), ("@sendgrid/", "EMAIL_NOTIFICATION"), ("@react-email/", "EMAIL_NOTIFICATION"), ("@mailchimp/", "EMAIL_NOTIFICATION"), ("@elastic/", "SEARCH"), ("@adminjs/", "ADMIN"), ("@octokit/", "API_INTEGRATION"))
LEXICON = {
    "AUTHENTICATION": "login logout signin signout auth authentication authenticate authorize authorization session sessions password passwords credential credentials oauth jwt sso otp token tokens forgot",
    "REGISTRATION": "register registration signup onboarding onboard verification verify activation activate confirmation",
    "PAYMENTS": "payment payments payout billing invoice invoices checkout subscription subscriptions refund refunds transaction transactions stripe paypal wallet pricing coupon",
    "USER_PROFILE": "profile profiles avatar account accounts preference preferences",
    "EMAIL_NOTIFICATION": "email emails mail mailer smtp notification notifications notify newsletter sms",
    "ADMIN": "admin admins administrator administrators moderation moderator moderators",
    "FILE_STORAGE": "upload uploads uploader download downloads attachment attachments storage bucket buckets media",
    "SEARCH": "search searching autocomplete elasticsearch algolia meilisearch",
    "API_INTEGRATION": "webhook webhooks integrations",
}
INFRA_CLUSTERS = ("Shared Infrastructure", "DevOps & Database Migrations")
ROLES = ("OWNER", "ADMIN", "MEMBER", "VIEWER")
CODE_WORDS = "const let var function return import export from default class extends interface type enum async await try catch throw new this super null undefined true false if else for while do switch case break continue void typeof instanceof require module exports".split()
