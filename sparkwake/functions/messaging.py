"""Names of messaging calls."""

from __future__ import annotations

#: Methods that send, receive or declare, receivers of a plain send, and annotations of listeners.
SENDS = (
    "publish", "publishasync", "basic_publish", "basicpublish", "basicpublishasync", "produce", "produceasync", "sendtoqueue", "convertandsend", "sendmessage", "sendmessageasync",
    "sendmessagebatch", "putevents", "putrecord", "publishbatch",
)
RECEIVES = (
    "subscribe", "subscribeasync", "psubscribe", "consume", "consumeasync", "basic_consume", "basicconsume", "basicconsumeasync", "receivemessage", "receivemessageasync", "addsubscription",
    "queuesubscribe", "subscribesync", "chansubscribe",
)
DECLARES = (
    "queue_declare", "queuedeclare", "queuedeclareasync", "assertqueue", "queue_bind", "queuebind", "queuebindasync", "bindqueue", "exchange_declare", "exchangedeclare", "exchangedeclareasync",
    "assertexchange", "createtopic", "createqueue", "topicarn", "queueurl", "topic_arn", "queue_url", "topic", "subscription",
)
SENDERS = ("producer", "kafka", "template", "publisher", "topic", "queue", "sqs", "sns", "pubsub", "eventhub", "bus", "stream", "bridge")
LISTENERS = ("KafkaListener", "RabbitListener", "JmsListener", "SqsListener", "StreamListener", "PulsarListener", "NatsListener", "ServiceBusTrigger", "QueueTrigger", "EventHubTrigger", "KafkaTrigger", "RabbitMQTrigger", "Incoming")
SPEAKERS = ("SendTo", "Outgoing")
METHODS = frozenset((*SENDS, *RECEIVES, *DECLARES, "send", "sendasync", "emit", "writemessages"))
#: Types whose making sends or receives, keys of literals whose values are topics, base types of handlers.
SEND_TYPES = r"(?i)(?:ProducerMessage|WriterConfig|kafka\.Writer|ProducerRecord|PublishRequest|SendMessageRequest|PublishCommand|SendMessageCommand)$"
RECEIVE_TYPES = r"(?i)(?:ConsumerMessage|ReaderConfig|kafka\.Reader|KafkaConsumer|SubscribeRequest|ReceiveMessageRequest|ReceiveMessageCommand)$"
TOPIC_KEYS = r"(?i)^(?:topics?|queues?|queuename|queueurl|exchange|routing_?key|subjects?|channels?|topic_?arn|destination)$"
HANDLERS = r"^I?[A-Za-z_]\w*?(?:IntegrationEventHandler|EventHandler|MessageHandler|Consumer|HandleMessages)$"
NO_HANDLERS = r"^(?:INotificationHandler|IRequestHandler)"
