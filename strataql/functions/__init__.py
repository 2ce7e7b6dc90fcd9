"""The dialect's functions: compositions of Spark built-ins where they can express them, else Arrow UDFs."""
