"""Texts and word lists that decide results.

These strings must read exactly like this for answers to come out right.  Names of
the service and of the vehicle are left as ``{assistant}`` and ``{vehicle}``.
"""

# Channels an answer can be formatted for.
CHANNELS = ["whatsapp", "telegram", "web", "api"]

# Message types that are refused, and texts that are greeted.
MEDIA_TYPES = ["image", "document", "audio", "video"]
GREETINGS = ["hi", "hello", "start", "help"]

# Replies to messages.
MEDIA_REPLY = "📎 I can only process text messages right now. Please send your question as text."
LOCATION_REPLY = "📍 Thanks for sharing your location! I'll help you find nearby stations and routes."
UNKNOWN_REPLY = "🤔 I didn't understand that message type. Please send a text message with your question."
ERROR_REPLY = """😔 *Sorry, something went wrong!*

Please try again or contact support if the issue persists.

Type *help* for assistance."""
WELCOME_REPLY = """🚌 *Welcome to {assistant}!*

I'm your AI assistant for {vehicle} transport. I can help you with:

• Route planning
• Station information
• Fare inquiries
• Transport options
• General {vehicle} info

*Examples:*
• "How do I get from Madina to Circle?"
• "Where is Kaneshie station?"
• "What's the fare from Kumasi to Accra?"

Type your question and I'll help! 😊"""

HELP_REPLY = """🚌 *{assistant} Help*

I can help you with:
• Route planning (e.g., "How do I get from Madina to Circle?")
• Station information (e.g., "Where is Kaneshie station?")
• Fare inquiries (e.g., "How much from Kumasi to Accra?")
• Transport options (e.g., "What's the best way to travel?")
• General {vehicle} information

*Examples:*
• "Madina to Circle route"
• "Accra stations"
• "{vehicle} fare Circle to Tema"
• "What is a {vehicle}?"

Type your question and I'll help you! 😊"""

# Answer of last resort.
NO_ANSWER = "I'm sorry, I don't have information about that."

# Question forms of origin and destination.
OD_SEPARATOR = " to "
OD_HINT = "Please ask questions in the form 'Origin to Destination'."

# Answer formats per channel.
CHAT_FORMAT = "🚌 *%s*\n\n*Question:* %s\n\n*Answer:* %s\n\n%s\n_Type 'help' for more options_"
HTML_FORMAT = "🚌 <b>%s</b>\n\n<b>Question:</b> %s\n\n<b>Answer:</b> %s\n\n"
CONFIDENCE_LINES = {
    "High": "✅ *Confidence:* High\n",
    "Medium": "⚠️ *Confidence:* Medium\n",
    "Low": "❓ *Confidence:* Low - Consider rephrasing your question\n",
}

# Question and answer per station: {name}, {city}, {address}.
STATION_TEMPLATES = [
    ("How do I get to {name}?",
     "To get to {name}, you can take a {vehicle} or taxi. It's located at {address} in {city}."),
    ("What's the best route to {name}?",
     "The best route to {name} depends on your starting point. It's a station in {city}."),
    ("Where is {name} located?",
     "{name} is located at {address} in {city}."),
    ("How much does it cost to go to {name}?",
     "The cost to {name} varies depending on your starting point. Check current fares for specific routes."),
    ("What stations are near {name}?",
     "You can find stations near {name} by checking the {city} transport network."),
    ("Is {name} a bus stop?",
     "Yes, {name} is a station in the transport network."),
    ("What city is {name} in?",
     "{name} is in {city}."),
    ("Tell me about {name} station",
     "{name} is a station located at {address} in {city}."),
]

# Question and answer per route: {name}, {long_name}, {city}.
ROUTE_TEMPLATES = [
    ("Tell me about route {name}",
     "Route {name} ({long_name}) operates in {city}. It connects various stations across the city."),
    ("What is the {name} route?",
     "The {name} route is called '{long_name}' and operates in {city}."),
    ("Where does route {name} go?",
     "Route {name} ({long_name}) serves stations in {city}."),
    ("How long is the {name} route?",
     "Route {name} covers multiple stations in {city}. Check the schedule for specific timing."),
    ("What are the stops on route {name}?",
     "Route {name} ({long_name}) has multiple stops across {city}."),
]

# Question, answer within one city, answer between two cities: {name1}, {name2}, {city1}, {city2}.
TRIP_TEMPLATES = [
    ("How do I get from {name1} to {name2}?",
     "To travel from {name1} to {name2} in {city1}, you can take a {vehicle} or taxi. Check the available routes.",
     "To travel from {name1} ({city1}) to {name2} ({city2}), you'll need intercity transport. Check bus schedules."),
    ("What's the route from {name1} to {name2}?",
     "The route from {name1} to {name2} is within {city1}. Look for connecting routes or direct {vehicle}s.",
     "The route from {name1} ({city1}) to {name2} ({city2}) requires intercity travel. Look for bus or taxi services."),
    ("How much does it cost from {name1} to {name2}?",
     "The cost from {name1} to {name2} depends on the route and transport type. Check current fares.",
     "Travel from {name1} to {name2} is intercity ({city1} to {city2}). Costs vary by transport type."),
    ("Can I travel from {name1} to {name2}?",
     "Yes, you can travel from {name1} to {name2} within {city1} using local transport.",
     "Yes, you can travel from {name1} ({city1}) to {name2} ({city2}) using intercity transport."),
    ("What's the best way to travel from {name1} to {name2}?",
     "The best way from {name1} to {name2} in {city1} is by {vehicle} or taxi, depending on available routes.",
     "For {name1} to {name2} travel, use intercity buses or taxis as they're in different cities."),
]

# Question, answer and context about the service itself: {service}, {country}.
GENERAL_TEMPLATES = [
    ("What is a {vehicle}?",
     "A {vehicle} is a popular form of public transportation in {country}, typically a shared minibus that follows fixed routes.",
     "general"),
    ("How do I pay for {vehicle}?",
     "You can pay for {vehicle} with cash to the conductor, or increasingly with mobile money and digital payment systems.",
     "payment"),
    ("What are the transport options in {country}?",
     "{country} has {vehicle}s, taxis, buses, okadas (motorcycles), and pragyas (three-wheelers) for public transport.",
     "transport_types"),
    ("How do I find the nearest station?",
     "Use the {service} app or website to find the nearest station to your location using GPS.",
     "app_usage"),
    ("What cities does {service} cover?",
     "{service} covers major cities including Accra, Kumasi, and is expanding to other cities in {country} and Africa.",
     "coverage"),
]

# Keywords in column names that hint at a model target.
REGRESSION_KEYWORDS = ["fare", "price", "cost", "duration", "time", "distance", "speed"]
CLASSIFICATION_KEYWORDS = ["route", "destination", "origin", "station", "vehicle_type", "status"]


# Cells of a delimited file that mean "missing".
MISSING_CELLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
    "None", "n/a", "nan", "null",
]
