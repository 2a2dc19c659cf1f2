"""quirespark: analytics over ordered document collections, as DataFrame-to-DataFrame operators."""
