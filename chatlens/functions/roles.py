"""Who wrote an event.

Human and system traffic do not complement each other: an agent without a nick is neither, a client
who calls themself like the bot is both.
"""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Roles:
    """Predicates over USERTYPE and USERNICK; a null operand gives a null predicate."""

    # User types of the log export and the nick of its bot.
    client: str = "CLIENT"
    agent: str = "AGENT"
    external: str = "EXTERNAL"
    bot_nick: str = "Live Chat"

    def is_client(self) -> Column:
        return F.col("USERTYPE") == self.client

    def is_agent(self) -> Column:
        return F.col("USERTYPE") == self.agent

    def is_external(self) -> Column:
        return F.col("USERTYPE") == self.external

    def is_bot(self) -> Column:
        return F.col("USERNICK") == self.bot_nick

    def is_human_agent(self) -> Column:
        return self.is_agent() & ~self.is_bot()

    def is_human(self) -> Column:
        return self.is_client() | self.is_human_agent()

    def is_system(self) -> Column:
        return self.is_external() | self.is_bot()


ROLES = Roles()
