"""Views as lazy plans over keyed tables."""
