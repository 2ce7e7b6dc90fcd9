"""The dialect's front end: text to tokens, tokens to syntax trees."""
